"""Best-fit packing of tokenized documents into sequences of a fixed length.

The tasks tokenize their documents and cut only those longer than a sequence, the first piece being the shorter one.
Packing is bulk-synchronous best fit. Pieces are ranked within their length over the whole cluster: a length of many
pieces is split by a hash into shares of about ``SHARE`` rows, which are sorted side by side, and a rank is that in the
share plus the sizes of the shares before it. Sorted pieces and sorted gaps are runs of equal numbers, at most one run for
each length, so the successor sweep of a round (which run of gaps is the least that holds this run of pieces) works
on at most ``SEQUENCE`` runs whatever the number of documents; within a run, conflicts are resolved by rank: the k-th
piece takes the k-th gap. The gaps shrink, and the sweeps go on until all is placed; when no gap holds a piece, new
sequences are opened. As runs are so few, the driver does the sweeps; no piece is collected. Their result is a short
list of intervals of ranks, which is broadcast, and every piece looks up its sequence and its place there.

The ids are those of the byte-level BPE in the ``tokenizers`` file; its merges are run by ``tiktoken`` on the same
vocabulary and pattern (equal ids, several times faster), except for very long texts and texts that hold a special
token, which go through ``tokenizers``.

Cases: a null text is empty: one piece of the end id alone; a text is never dropped or cut short; repeated rows are
packed as often as they occur; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import bounded, documents, small_batches, store

SEQUENCE = 2_048
END_ID = 0
SHARE = 250_000
#: Characters from which a text goes through ``tokenizers``.
LONG = 1_000_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 bytes are themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [x for x in range(256) if x not in plain]
    return {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}


class Encoder:
    def __init__(self, path: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = [x["content"] for x in told.get("added_tokens", [])]
        symbol = byte_symbols()
        ranks = {bytes(symbol[c] for c in word): k for word, k in told["model"]["vocab"].items() if word not in self.special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    @cached_property
    def slow(self):
        """The ``tokenizers`` object: some 100 MB that most tasks never need."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def __call__(self, text: str) -> list[int]:
        if len(text) >= LONG or any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first may be shorter, the others have ``size``."""
    first = n if n <= size else n % size or size
    return [(0, first), *((a, size) for a in range(first, n, size))]


def pieces(df: DataFrame, vocabulary: str, size: int = SEQUENCE, end: int = END_ID) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for b in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, text in enumerate(b.column("text").to_pylist()):
                raw = np.array([*encode(text or ""), end], "<u4")
                for p, (a, n) in enumerate(cut(len(raw), size)):
                    row.append(k)
                    piece.append(p)
                    start.append(a)
                    length.append(n)
                    crc.append(zlib.crc32(raw[a : a + n]))
            made = [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return small_batches(df.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def sweep(runs: dict[int, int], size: int = SEQUENCE) -> np.ndarray:
    """Best fit over runs (length -> number of pieces): rows (length, first rank, count, first sequence, offset).

    A group of sequences with the same content is (count, [(length, first rank, offset), ...]), filed under its gap.
    """
    gaps: dict[int, list] = defaultdict(list)
    for length in sorted((x for x, n in runs.items() if n), reverse=True):
        rank, left = 0, runs[length]
        while left:
            gap = next((g for g in range(length, size) if gaps[g]), None)
            if gap is None:
                fits = size // length
                for bins, each in ((left // fits, fits), (1, left % fits)):
                    if bins and each:
                        gaps[size - each * length].append((bins, [(length, rank + k * bins, k * length) for k in range(each)]))
                        rank += bins * each
                break
            count, held = gaps[gap].pop()
            take = min(count, left)
            if take < count:
                gaps[gap].append((count - take, [(n, r + take, o) for n, r, o in held]))
            gaps[gap - length].append((take, [*held, (length, rank, size - gap)]))
            rank, left = rank + take, left - take
    out, sequence = [], 0
    for gap in sorted(gaps):
        for count, held in gaps[gap]:
            out += [(n, r, count, sequence, o) for n, r, o in held]
            sequence += count
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def ranked(cut_: DataFrame, runs: dict[int, int]) -> DataFrame:
    """Add ``rank``, from 0 among all pieces of a length: the rank in the piece's share plus the shares before.

    ``runs`` has the number of pieces of each length.
    """
    shares = cut_.sparkSession.createDataFrame([(int(x), -(-n // SHARE)) for x, n in runs.items()], "length long, shares long")
    salted = cut_.join(F.broadcast(shares), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("shares"))).drop("shares")
    local = salted.withColumn("own", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    sizes = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))  # a row for each SHARE pieces, and one a length
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("base"))
    return local.join(bounded(before), ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own")).drop("salt", "own", "base")


def pack(df: DataFrame, vocabulary: str | None = None, size: int = SEQUENCE, end: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of the texts of ``df``."""
    cut_ = store(pieces(df, vocabulary or default_vocabulary(), size, end), "pieces")
    runs = {r["length"]: r["count"] for r in cut_.groupBy("length").count().collect()}  # at most SEQUENCE rows
    sent = df.sparkSession.sparkContext.broadcast(sweep(runs, size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = sent.value
        key = (plan[:, 0] << 48) + plan[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, (length << 48) + rank, "right") - 1
            sequence = plan[at, 3] + rank - plan[at, 1]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in names], pa.array(sequence), pa.array(plan[at, 4])], [*names, "sequence_id", "offset"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return ranked(cut_, runs).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir, "doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every remaining document is packed, a null text as its end id alone; repeated rows each."""
    return pack(docs)
