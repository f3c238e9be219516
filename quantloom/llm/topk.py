"""Exact top-k inner products over a bit-sliced index.

Vectors are turned into integers, floor(256 * x). The index packs up to ``BLOCK`` vectors of one length into a block:
for each attribute the distance from the block's least value, without its lowest bits (so that at most
``SLICE_BITS`` are left), as one bitmap over the rows for each bit, and beside it the exact integers. Blocks are
stored as a table.

A query adds the bitmaps: each attribute slice counts once for every one in the query's factor (slices of attributes
with a negative factor are complemented), and carry-save adders turn the list of bitmaps of each weight into the bit
slices of the sum. From the most significant slice downward the k-th largest sum is found, then the rows whose sum
comes so near to it that the dropped low bits could matter; these boundary rows are scored exactly. The best rows of
the blocks meet in a window over at most k rows for each query and block.

Queries are packed in chunks, and each chunk meets each block once, so memory is bounded by a block and a chunk.

Cases: vectors that are null or have a null or non-finite component, and rows without an id, take no part; vectors of
different lengths never meet (their inner product is undefined); rows that repeat an id are rows of their own, and a
query leaves out only its own row; ids are integers; equal scores go to the smaller id; a score beyond 64 bits is ranked exactly and
returned as the nearest long; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import store, table

K = 5
EVERY = 50
SCALE = 256
SLICE_BITS = 6
BLOCK = 1 << 15
CHUNK = 256


def scaled_bytes(values: np.ndarray) -> bytes:
    """floor(256 * x), as 16-bit integers if all fit, else as doubles."""
    scaled = np.floor(values * SCALE)
    return scaled.astype(np.int16 if not scaled.size or np.abs(scaled).max() < 1 << 15 else np.float64).tobytes()


def integers(raw: bytes, n: int, dim: int) -> np.ndarray:
    """What :func:`scaled_bytes` packed: int64 while sums of products stay safe, else Python integers."""
    scaled = np.frombuffer(raw, np.int16 if len(raw) == 2 * n * dim else np.float64).reshape(n, dim)
    if not scaled.size or np.abs(scaled).max() < (1 << 24):
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled], object).reshape(n, dim)


def bitmap(flags: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    n = flags.shape[-1]
    padded = np.zeros((*flags.shape[:-1], -(-n // 64) * 64), np.uint8)
    padded[..., :n] = flags
    return np.packbits(padded, axis=-1, bitorder="little").view(np.uint64)


def sliced(exact: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Bits dropped, bits kept, and the bit slices (attributes x bits x words) of the rows of ``exact``."""
    low = exact.min(axis=0)
    spread = int((exact.max(axis=0) - low).max()) if exact.shape[1] else 0
    drop, bits = max(0, spread.bit_length() - SLICE_BITS), min(spread.bit_length(), SLICE_BITS)
    kept = ((exact - low) >> drop).astype(np.int64)
    return drop, bits, np.stack([bitmap((kept.T >> b & 1).astype(bool)) for b in range(bits)], axis=1) if bits else np.zeros((exact.shape[1], 0, 0), np.uint64)


class Block:
    """Rows of the index: ids, numbers of their own, exact integers and the bit slices of these."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, exact: np.ndarray, index: tuple[int, int, np.ndarray] | None = None) -> None:
        self.ids, self.own, self.exact = ids, own, exact
        self.n, self.dim = exact.shape
        self.drop, self.bits, self.slices = index or sliced(exact)
        self.all = bitmap(np.ones((1, self.n), bool))[0]

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Bit slices, least significant first, of the sum over attributes of |factor| * (kept value or its complement)."""
        by_weight: list[list[np.ndarray]] = []
        for d, factor in enumerate(query.tolist()):
            size, negative = abs(factor), factor < 0
            part = (~self.slices[d] & self.all) if negative else self.slices[d]
            while size:
                at = (size & -size).bit_length() - 1
                size &= size - 1
                while len(by_weight) < at + self.bits:
                    by_weight.append([])
                for b in range(self.bits):
                    by_weight[at + b].append(part[b])
        out, w = [], 0
        while w < len(by_weight):
            held = by_weight[w]
            if len(held) > 1 and w + 1 == len(by_weight):
                by_weight.append([])
            while len(held) > 2:  # full adder
                x, y, z = held.pop(), held.pop(), held.pop()
                t = x ^ y
                held.append(t ^ z)
                by_weight[w + 1].append((x & y) | (t & z))
            if len(held) == 2:  # half adder
                x, y = held
                held[:] = [x ^ y]
                by_weight[w + 1].append(x & y)
            out.append(held[0] if held else np.zeros_like(self.all))
            w += 1
        return out

    def boundary(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best: all rows whose true score could reach the k-th."""
        if self.n <= k or not self.bits:
            return np.arange(self.n)
        sums = self.sums(query)
        great, equal, least = np.zeros_like(self.all), self.all, 0
        for b in range(len(sums) - 1, -1, -1):
            ones = equal & sums[b]
            if int(np.bitwise_count(great | ones).sum()) >= k:
                equal, least = ones, least | 1 << b
            else:
                great, equal = great | ones, equal & ~sums[b]
        # the dropped bits of a row add between 0 and (2^drop - 1) * |factor| on either side
        slack = sum(abs(int(x)) for x in query.tolist()) * ((1 << self.drop) - 1)
        least = max(0, least - -(-slack >> self.drop) - 1) if self.drop else least
        great, equal = np.zeros_like(self.all), self.all
        for b in range(len(sums) - 1, -1, -1):
            if least >> b & 1:
                equal = equal & sums[b]
            else:
                great, equal = great | (equal & sums[b]), equal & ~sums[b]
        rows = np.unpackbits((great | equal).view(np.uint8), bitorder="little")[: self.n]
        return np.flatnonzero(rows)

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, list]:
        """Ids and exact scores of the k best rows but the query's own, best first, equal scores by id."""
        rows = self.boundary(query, k + 1)
        rows = rows[self.own[rows] != own]
        scores = self.exact[rows] @ query
        order = np.lexsort((self.ids[rows], -scores))[:k] if scores.dtype != object else np.array(sorted(range(len(rows)), key=lambda i: (-scores[i], self.ids[rows[i]]))[:k], np.int64)
        return self.ids[rows[order]], [int(x) for x in scores[order]]


def usable(df: DataFrame, id_column: str, vector: str) -> DataFrame:
    """(id, own, v): vectors that take part, as doubles, with a number of the row's own."""
    rows = df.select(F.col(id_column).cast("long").alias("id"), F.monotonically_increasing_id().alias("own"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(F.coalesce(x, F.lit(0.0))) & (F.abs(F.coalesce(x, F.lit(0.0))) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(fine)


def packed(rows: DataFrame, most: int, index: bool) -> DataFrame:
    """Rows (id, own, v) in runs of one vector length: (part, dim, n, ids, owns, v) and, for an index, bit slices."""
    names = ["part", "dim", "n", "ids", "owns", "v", "dropped", "bits", "slices"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 33
        held: dict[int, list] = {}
        made = 0

        def flush(dim: int) -> pa.RecordBatch:
            ids, own, values = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            raw = scaled_bytes(values)
            drop, bits, slices = sliced(integers(raw, *values.shape)) if index else (0, 0, np.zeros(0))
            row = [[base + made], [dim], [len(ids)], [ids.tobytes()], [own.tobytes()], [raw], [drop], [bits], [slices.tobytes()]]
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds, strict=True)], names)

        for b in batches:
            lists = b.column("v")
            lengths = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy()
            starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
            ids, own = b.column("id").to_numpy(), b.column("own").to_numpy()
            for dim in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == dim)
                for a in range(0, len(at), most):
                    part = at[a : a + most]
                    values = flat[starts[part][:, None] + np.arange(dim)] if dim else np.zeros((len(part), 0))
                    held.setdefault(dim, []).append((ids[part], own[part], values))
                    if sum(len(x[0]) for x in held[dim]) >= most:
                        yield flush(dim)
                        made += 1
        for dim in list(held):
            yield flush(dim)
            made += 1

    return rows.mapInArrow(run, "part long, dim int, n int, ids binary, owns binary, v binary, dropped int, bits int, slices binary")


def unpacked(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["ids"], np.int64), np.frombuffer(row["owns"], np.int64), integers(row["v"], row["n"], row["dim"])


def order_key(s: int) -> bytes:
    """Bytes that compare as the integers do, however large."""
    raw = abs(s).to_bytes(-(-abs(s).bit_length() // 8), "big")
    key = len(raw).to_bytes(4, "big") + raw
    return b"\1" + key if s >= 0 else b"\0" + bytes(255 - x for x in key) + b"\xff"


def meet(queries: pa.Table, blocks: pa.Table, k: int) -> pa.Table:
    """The k best of each block for each query of the chunks."""
    out: list[tuple] = []
    for b in blocks.to_pylist():
        slices = np.frombuffer(b["slices"], np.uint64).reshape(b["dim"], b["bits"], -1 if b["bits"] else 0)
        block = Block(*unpacked(b), (b["dropped"], b["bits"], slices))
        for q in queries.to_pylist():
            for query_id, own, values in zip(*unpacked(q), strict=True):
                if values.dtype != block.exact.dtype:
                    values, block.exact = values.astype(object), block.exact.astype(object)
                ids, scores = block.best(values, own, k)
                out += [(int(own), int(query_id), int(i), order_key(s), s) for i, s in zip(ids, scores, strict=True)]
    own, query_id, ids, exact, scores = zip(*out, strict=True) if out else ([],) * 5
    return pa.table({"own": pa.array(own, pa.int64()), "query_id": pa.array(query_id, pa.int64()), "vec_id": pa.array(ids, pa.int64()), "exact": pa.array(exact, pa.binary()), "score": pa.array([max(-(1 << 63), min(s, (1 << 63) - 1)) for s in scores], pa.int64())})


def top_k(df: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = K, every: int = EVERY) -> DataFrame:
    """query_id, rank, vec_id and score: the k best rows for every row whose id is divisible by ``every``."""
    rows = usable(df, id_column, vector)
    # a fixed number of rows to a block and a chunk, so that blocks are full whatever the files look like
    rows = store(rows, "vectors")
    n = rows.count()
    asked = rows.where(F.pmod("id", F.lit(every)) == 0)
    n_asked = asked.count()
    groups, chunks = max(1, -(-n // BLOCK)), max(1, -(-n_asked // CHUNK))
    index = store(packed(rows.repartition(groups), BLOCK, True), "bit-slices")
    query = store(packed(asked.repartition(chunks), CHUNK, False), "query-chunks")
    # blocks and chunks are dealt to a grid; every pair of a block and a chunk of one length meets in one cell of it
    g, c = min(groups, 1024), min(chunks, 1024)
    left = query.withColumn("cell_c", F.pmod(F.xxhash64("part"), F.lit(c))).withColumn("cell_g", F.explode(F.sequence(F.lit(0), F.lit(g - 1))))
    right = index.withColumn("cell_g", F.pmod(F.xxhash64("part"), F.lit(g)).cast("int")).withColumn("cell_c", F.explode(F.sequence(F.lit(0), F.lit(c - 1))))
    keys = ["dim", "cell_g", "cell_c"]
    left = left.withColumn("cell_c", F.col("cell_c").cast("int"))
    met = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(lambda q, b: meet(q, b, k), "own long, query_id long, vec_id long, exact binary, score long")
    order = Window.partitionBy("own").orderBy(F.desc("exact"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
