"""SimHash near-duplicates with pivot distance tables.

A fingerprint has a bit set where over half the XXH64 values of a text's 3-word shingles have it. Fingerprints link
at ``MAX_DISTANCE`` or fewer differing bits. Two such fingerprints agree on at least two of five bands of bits, so
each distinct fingerprint is filed under its ten pairs of bands, and only fingerprints in one file are compared.
There, the Hamming distances to many fixed reference fingerprints (the pivots) are tabled once; a pair is discarded
when any coordinate differs by more than the allowed distance (the triangle inequality), and survivors are verified.
A file of more than ``RUN`` fingerprints is split again: of four sub-bands of its free bits one must agree, until no
bits are left to split by, so no pair is lost and no pair list is kept: each block of pairs is reduced to a spanning
forest. The forests meet in distributed connected components.

Copies share a fingerprint and are one node; only distinct fingerprints are filed, so a group of copies of any size
costs one row in each file.

Cases: a null or empty text has fingerprint zero, linked like any other; a text of fewer than three words is one
shingle; a null doc_id takes part but is never a component id (a component of nulls alone has a null one); repeated
rows appear as often as they occur; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import ROW, documents, numbered, small_batches, store, without_rows
from quantloom.llm.graph import connected_components, spanning_edges

SHINGLE = 3
SEED = 42
MAX_DISTANCE = 3
PIVOTS = 32
RUN = 2_048
#: Shingles of one text hashed at a time.
SLICE = 1 << 18

#: Five bands of the 64 bits; any two fingerprints that differ in at most three bits agree on two of them.
BANDS = [np.uint64(((1 << w) - 1) << at) for at, w in ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))]
BAND_PAIRS = list(combinations(range(5), 2))


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, 0) for i in range(n)], np.uint64)


def fingerprint(raw: bytes, size: int = SHINGLE) -> int:
    """SimHash of a UTF-8 text: words between ASCII white space, A-Z folded, shingles of ``size`` words."""
    words = raw.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n]
    ends = ends[min(size, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for a in range(0, n, SLICE):
        found = [digest(joined[i:j], SEED) for i, j in zip(starts[a : a + SLICE].tolist(), ends[a : a + SLICE].tolist(), strict=True)]
        bits = np.unpackbits(np.array(found, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("text").cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(x or b"") for x in raw], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    kind = df.schema["doc_id"].dataType.simpleString()
    return small_batches(df.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, fp long")


def verified(fps: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) within ``most`` bits: first by the pivot table, a few coordinates at a time, then exactly."""
    for at in range(0, table.shape[1], 8):
        part = table[:, at : at + 8]
        keep = (np.abs(part[a] - part[b]) <= most).all(axis=1)
        a, b = a[keep], b[keep]
    keep = np.bitwise_count(fps[a] ^ fps[b]) <= most
    return a[keep], b[keep]


def block_links(fps: np.ndarray, table: np.ndarray, at: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning edges among the rows ``at``: sorted by the first pivot's distance, so that each row meets a window only."""
    at = at[np.argsort(table[at, 0], kind="stable")]
    key = table[at, 0]
    out = []
    for i in range(0, len(at), 256):
        j = min(i + 256, len(at))
        end = int(np.searchsorted(key, key[j - 1] + MAX_DISTANCE, "right"))
        for k in range(i, end, 2_048):
            m = min(k + 2_048, end)
            x, y = np.nonzero(np.abs(key[i:j, None] - key[None, k:m]) <= MAX_DISTANCE)
            x, y = x + i, y + k
            x, y = x[y > x], y[y > x]
            x, y = verified(fps, table, at[x], at[y])
            out.append(spanning_edges(x, y))
    return out


def run_links(fps: np.ndarray, table: np.ndarray, at: np.ndarray, free: list[int], most: int = RUN) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning edges among the rows ``at`` of one file; ``free``: bits by which it may be split further."""
    if len(at) < 2:
        return []
    if len(at) <= most or len(free) < MAX_DISTANCE + 1:
        return block_links(fps, table, at)
    out = []
    for part in np.array_split(np.array(free), MAX_DISTANCE + 1):
        mask = np.uint64(sum(1 << int(x) for x in part))
        value = fps[at] & mask
        order = np.argsort(value, kind="stable")
        cuts = np.flatnonzero(np.diff(value[order])) + 1
        left = [x for x in free if x not in set(part.tolist())]
        for group in np.split(at[order], cuts):
            out += run_links(fps, table, group, left, most)
    return out


def file_links(files: np.ndarray, keys: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (values) of all files of a partition: rows (file number, key, fingerprint)."""
    distinct, code = np.unique(fps, return_inverse=True)
    table = np.bitwise_count(distinct[:, None] ^ pivots()[None, :]).astype(np.int8)
    order = np.lexsort((keys, files))
    files, keys, code = files[order], keys[order], code[order]
    new = np.concatenate(([True], (files[1:] != files[:-1]) | (keys[1:] != keys[:-1])))
    starts = np.flatnonzero(new)
    sizes = np.diff(np.concatenate((starts, [len(files)])))
    run = np.cumsum(new) - 1
    edges = []
    small = np.where(sizes <= 32, sizes, 0)
    for d in range(1, int(small.max(initial=0))):
        i = np.flatnonzero((run[:-d] == run[d:]) & (small[run[:-d]] > d))
        edges.append(verified(distinct, table, code[i], code[i + d]))
    for k in np.flatnonzero(sizes > 32):
        i, j = BAND_PAIRS[files[starts[k]]]
        fixed = int(BANDS[i] | BANDS[j])
        edges += run_links(distinct, table, code[starts[k] : starts[k] + sizes[k]], [x for x in range(64) if not fixed >> x & 1])
    if not edges:
        return distinct[:0], distinct[:0]
    a, b = spanning_edges(np.concatenate([x for x, _ in edges]), np.concatenate([y for _, y in edges]))
    return distinct[a], distinct[b]


def links(nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) that connect all fingerprints ``fp`` of ``nodes`` (distinct) linked within the distance."""
    masks = [int((BANDS[i] | BANDS[j]).astype(np.int64)) for i, j in BAND_PAIRS]
    filed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("file", "key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if got:
            t = pa.Table.from_batches(got)
            a, b = file_links(t["file"].to_numpy(), t["key"].to_numpy(), t["fp"].to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["src", "dst"])

    return filed.repartition("file", "key").mapInArrow(run, "src long, dst long")


def components(prints: DataFrame) -> DataFrame:
    """(doc_id, fp) -> the same rows with component_id."""
    nodes = store(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = connected_components(links(nodes.select("fp")))
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    label = named.join(least, "root").select("fp", "component_id")
    return prints.join(label, "fp", "left")


def near_duplicates(df: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row of ``df`` (doc_id, text)."""
    prints = store(fingerprints(df), "simhash-prints")
    return components(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir, "doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of near copies the row with the smallest (doc_id, row number) stays.

    Rows without a doc_id stay too; null and empty texts are copies of each other; an empty table stays empty.
    """
    docs = numbered(docs)
    key = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", ROW))
    found = near_duplicates(docs.select(key.alias("doc_id"), "text"))
    return without_rows(docs, found.where(F.col("doc_id") != F.col("component_id")).select(F.col(f"doc_id.{ROW}").alias(ROW)))
