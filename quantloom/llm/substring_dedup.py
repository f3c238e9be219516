"""Exact substring deduplication: suffix arrays over the stretches of text that can hold a repeat.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts earlier (in a document of smaller id, or earlier
in the same one). Every such string holds an anchor: the ``ANCHOR``-byte string in it of least hash, the leftmost of
equals, which depends on nothing but the string, so that equal strings have equal anchors. A document is cut in
segments, the runs of strings that share an anchor (at most WIDTH + WIDTH - ANCHOR bytes), and a repeat can only be
found among segments of equal anchor. This is the sharding of the suffix sort:

1. A task hashes its texts and lists the segments: hash of the anchor, and place. Segments of a task that are equal byte
   by byte are reduced to the first, and the strings of the later ones are marked at once, so a group of copies costs one
   row for each task, whatever its size.
2. The lists are shuffled by anchor. A segment whose anchor no other has cannot repeat; the others are fetched from the
   texts.
3. Each goes to up to two shards, by the hash of the anchor with the bytes up to 34 before or after it: one of the two
   is part of every string around the anchor. So a common phrase does not gather in one shard unless its
   surroundings are as common. A shard builds the suffix array of its segments by induced sorting, computes permuted
   common prefixes, and in each group of suffixes that share WIDTH bytes marks all but the earliest. Parts of the same
   bytes enter it once.
4. Marks of a document are merged, and its remaining bytes are hashed.

So hashes only choose what is compared: bytes decide within a task, and suffix arrays between tasks.

Cases: a null text is empty; texts shorter than WIDTH bytes stay whole; strings never cross documents; rows that
repeat an id, and rows without one (last), are documents of their own, in the order of their texts; an empty table
gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import documents, part_count, small_batches, store, text_bytes
from quantloom.llm.suffix_array import permuted_common_prefixes, suffix_array

WIDTH = 100
ANCHOR = 32
#: Positions of an anchor in a string.
PLACES = WIDTH - ANCHOR + 1
#: Bytes beside the anchor that the keys of shards take in: each string holds so many on one side at least.
SIDE = (WIDTH - ANCHOR) // 2
BLOCK = 1 << 18
CHUNK_BYTES = 32 << 20
#: Most bytes of a segment.
LONGEST = PLACES + WIDTH - 1
#: Bytes of fetched segments that one suffix array takes, about.
SHARD_BYTES = 4 << 20

_RANDOM = np.random.Generator(np.random.PCG64(100))
_BYTE = _RANDOM.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = [int(x) | 1 for x in _RANDOM.integers(1 << 62, 1 << 63, 12, dtype=np.uint64)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def window_hashes(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ANCHOR and of the WIDTH bytes from each position that has them."""
    h = {1: _BYTE[b]}
    m = 1
    while m < 64 and len(b) >= 2 * m:
        x = h[m]
        y = x[:-m] * np.uint64(_ODD[m.bit_length()])
        y += x[m:]
        h[2 * m] = y ^ (y >> np.uint64(32))
        m *= 2
    n = len(b) - WIDTH + 1
    wide = h[64][:n] * np.uint64(_ODD[9]) + h[32][64 : 64 + n] * np.uint64(_ODD[10]) + h[4][96 : 96 + n]
    return mixed(h[32]), mixed(wide)


def least_places(h: np.ndarray, n: int) -> np.ndarray:
    """For each of the first n positions, where the least of the next PLACES hashes stands, the leftmost of equals."""
    low = np.uint64((1 << 20) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    width = 1
    while width * 2 <= PLACES:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[:n], m[PLACES - width : PLACES - width + n])
    return (m & low).astype(np.int64)


def segments(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchor hash, segment hash, row, first string, strings, anchor's place in the first) of all rows, block by block.

    The segment hash only proposes equal segments.
    """
    ends = offsets[1:]
    for a in range(0, len(data) - WIDTH + 1, BLOCK):
        b = min(a + BLOCK, len(data) - WIDTH + 1)
        part = data[a : b + WIDTH - 1]
        row0, row1 = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b - 1, "right")) + 1
        cuts = np.clip(np.concatenate((offsets[row0:row1], ends[row1 - 1 : row1])), a, b)
        last = np.repeat(ends[row0:row1] - WIDTH, np.diff(cuts))
        at = np.flatnonzero(np.arange(a, b) <= last)
        if not len(at):
            continue
        anchor, wide = window_hashes(part)
        place = least_places(anchor, b - a)[at]
        new = np.concatenate(([True], (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)))
        first = np.flatnonzero(new)
        final = np.concatenate((first[1:], [len(at)])) - 1
        lo, hi, p = at[first], at[final], place[first]
        shape = ((p - lo) << 8 | (hi - lo)).astype(np.uint64)
        whole = mixed(wide[lo] * np.uint64(_ODD[11]) + wide[hi] + shape * np.uint64(_ODD[8]))
        row = np.searchsorted(ends, lo + a, "right")
        yield anchor[p], whole, row, lo + a - offsets[row], hi - lo + 1, p - lo


def firsts(f: np.ndarray, h: np.ndarray, key: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by (f, h, key, lo), and which of that order begin a new (f, h)."""
    order = np.argsort(f, kind="stable")
    same = f[order][1:] == f[order][:-1]
    # only runs of equal anchors need the finer order
    run = np.concatenate((same, [False])) | np.concatenate(([False], same))
    at = np.flatnonzero(run)
    part = order[at]
    order[at] = part[np.lexsort((lo[part], key[part], h[part], f[part]))]
    new = np.ones(len(order), bool)
    new[1:] = (f[order][1:] != f[order][:-1]) | (h[order][1:] != h[order][:-1])
    return order, new


def equal_segments(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the segments of ``size`` and ``sizes`` strings that begin at a and at b are the same bytes."""
    out = size == sizes
    for i in range(0, len(a), 1 << 14):
        s = slice(i, i + (1 << 14))
        at = np.arange(LONGEST)
        beyond = at >= (size[s] + WIDTH - 1)[:, None]
        x, y = (data[np.minimum(p[s][:, None] + at, len(data) - 1)] for p in (a, b))
        out[s] &= ((x == y) | beyond).all(axis=1)
    return out


def joined_runs(key: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marks [lo, hi] of keys, sorted, with neighbours and overlaps made one."""
    order = np.lexsort((lo, key))
    key, lo, hi = key[order], lo[order], hi[order]
    if not len(key):
        return key, lo, hi
    start = np.concatenate(([True], key[1:] != key[:-1]))
    group = np.cumsum(start) - 1
    span = int(hi.max()) + 2
    reach = np.maximum.accumulate(hi + group * span) - group * span  # the farthest end so far within a key
    new = start.copy()
    new[1:] |= lo[1:] > reach[:-1] + 1
    at = np.flatnonzero(new)
    return key[at], lo[at], reach[np.concatenate((at[1:], [len(key)])) - 1]


_LIST = "part int, n int, f binary, key binary, lo binary, size binary, place binary"
_FIELDS = {"f": np.uint64, "key": np.int64, "lo": np.int64, "size": np.uint8, "place": np.uint8}


def segment_lists(df: DataFrame, parts: int) -> DataFrame:
    """Packed lists of first segments by part, and of marks (size empty), from texts (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        texts: list[np.ndarray] = []
        size = 0

        def rows(part: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
            order = np.lexsort((columns["lo"], columns["key"], part))
            part = part[order]
            cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else np.zeros(1, np.int64)
            packed: list[list] = [[] for _ in range(7)]
            columns = {k: v[order] for k, v in columns.items()}
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                packed[0].append(int(part[i]))
                packed[1].append(j - i)
                for k, (name, kind) in enumerate(_FIELDS.items()):
                    packed[k + 2].append(columns[name][i:j].astype(kind).tobytes() if name in columns else b"")
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(packed, kinds, strict=True)], ["part", "n", *_FIELDS])

        def flush() -> Iterator[pa.RecordBatch]:
            f, h, key, lo, n, place, at = (np.concatenate(x) for x in zip(*held, strict=True))
            data = np.concatenate(texts)
            held.clear()
            texts.clear()
            order, new = firsts(f, h, key, lo)
            later = np.flatnonzero(~new)
            like = order[new][np.cumsum(new)[later] - 1]
            # what the hashes propose the bytes decide; a segment that only has the same hash stands for itself
            new[later] = ~equal_segments(data, at[like], at[order[later]], n[like], n[order[later]])
            later = order[~new]
            k, a, b = joined_runs(key[later], lo[later], lo[later] + n[later] - 1)
            # a mark is a run of strings of any length here, so its end takes the place of the anchor hash
            for i in range(0, len(k), 1 << 16):
                s = slice(i, i + (1 << 16))
                yield rows((k[s] % parts).astype(np.int32), {"key": k[s], "lo": a[s], "f": b[s]})
            kept = order[new]
            yield rows((f[kept] % np.uint64(parts)).astype(np.int32), {"f": f[kept], "key": key[kept], "lo": lo[kept], "size": n[kept], "place": place[kept]})

        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            keys = b.column("key").to_numpy()
            for f, h, row, lo, n, place in segments(data, offsets):
                held.append((f, h, keys[row], lo, n, place, offsets[row] + lo + size))
            texts.append(data)
            size += len(data)
            if size >= CHUNK_BYTES and held:
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return small_batches(df).mapInArrow(run, _LIST)


def sift(lists: pa.Table) -> pa.Table:
    """Of one part: marks (key, lo, hi) and the segments to compare (with f and place)."""
    got: dict[str, list] = {k: [] for k in _FIELDS}
    marks: list[tuple[np.ndarray, ...]] = []
    for r in lists.to_pylist():
        if r["size"]:
            for k, kind in _FIELDS.items():
                got[k].append(np.frombuffer(r[k], kind))
        else:
            marks.append((np.frombuffer(r["key"], np.int64), np.frombuffer(r["lo"], np.int64), np.frombuffer(r["f"], np.uint64).astype(np.int64)))
    f, key, lo, size, place = (np.concatenate([np.zeros(0, kind), *got[k]]) for k, kind in _FIELDS.items())
    size, place = size.astype(np.int64), place.astype(np.int64)
    kept = np.argsort(f, kind="stable")
    several = np.zeros(len(kept), bool)
    same = f[kept][1:] == f[kept][:-1]
    several[1:] |= same
    several[:-1] |= same
    v = kept[several]
    k, a, b = joined_runs(*(np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*marks, strict=True) if marks else [(), (), ()])))
    n = len(k)
    return pa.table({"key": np.concatenate((k, key[v])), "lo": np.concatenate((a, lo[v])), "hi": np.concatenate((b, lo[v] + size[v] - 1)), "place": np.concatenate((np.full(n, -1, np.int32), place[v].astype(np.int32))), "f": np.concatenate((np.zeros(n, np.int64), f[v].view(np.int64)))})


def halves(text: bytes, lo: int, hi: int, place: int) -> Iterator[tuple[int, int, bytes]]:
    """(first string, last string, key bytes) of the one or two parts of a segment whose anchor stands at lo + place."""
    a = lo + place
    if lo <= a - SIDE:
        yield lo, min(hi, a - SIDE), text[a - SIDE : a + ANCHOR]
    if hi > a - SIDE:
        yield max(lo, a - SIDE + 1), hi, text[a : a + ANCHOR + SIDE]


def fetched(texts: DataFrame) -> DataFrame:
    """(shard, key, lo, bytes): the parts of segments, from texts (key, text, wanted: array of lo, hi, place)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, key, first, held = [], [], [], []
            for k, text, wanted in zip(b.column("key").to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), b.column("wanted").to_pylist(), strict=True):
                for w in wanted:
                    for lo, hi, side in halves(text, w["lo"], w["hi"], w["place"]):
                        shard.append(int.from_bytes(hashlib.blake2b(side, digest_size=8).digest(), "little", signed=True))
                        key.append(k)
                        first.append(lo)
                        held.append(text[lo : hi + WIDTH])
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(key, pa.int64()), pa.array(first, pa.int64()), pa.array(held, pa.binary())], ["shard", "key", "lo", "bytes"])

    return small_batches(texts.select("key", "text", "wanted")).mapInArrow(run, "shard long, key long, lo long, bytes binary")


def repeats(parts: pa.Table) -> pa.Table:
    """Marks of the strings of a shard's parts that start earlier in another, or earlier in the same."""
    shard, key, lo = (parts[c].to_numpy() for c in ("shard", "key", "lo"))
    # parts of the same bytes need no sorting: the strings of all but the earliest are marked as they are
    same = pc.dictionary_encode(parts["bytes"].combine_chunks()).indices.to_numpy()
    size = pc.binary_length(parts["bytes"]).to_numpy().astype(np.int64)
    order = np.lexsort((lo, key, same, shard))
    again = np.zeros(len(order), bool)
    again[1:] = (same[order][1:] == same[order][:-1]) & (shard[order][1:] == shard[order][:-1])
    copies = order[again]
    copied = key[copies], lo[copies], lo[copies] + size[copies] - WIDTH
    first = order[~again]
    _, code, count = np.unique(shard[first], return_inverse=True, return_counts=True)
    use = np.sort(first[count[code] > 1])
    key, lo = key[use], lo[use]
    data, offsets = text_bytes(parts["bytes"].take(pa.array(use)))
    order = suffix_array(data, WIDTH)
    part = np.repeat(np.arange(len(use)), np.diff(offsets))
    place = np.arange(len(data)) - offsets[:-1][part] if len(use) else np.zeros(0, np.int64)
    whole = (np.arange(len(data)) + WIDTH <= offsets[1:][part]) if len(use) else np.zeros(0, bool)
    order = order[whole[order]] if len(data) else order[:0]  # suffixes that hold a string of their own part
    shared = permuted_common_prefixes(data, order, WIDTH)
    by_rank = np.empty(len(order), np.int64)
    by_rank[np.argsort(order, kind="stable")] = shared
    group = np.cumsum(by_rank < WIDTH)
    where_key, where_lo = key[part[order]], lo[part[order]] + place[order]
    ranked = np.lexsort((where_lo, where_key, group))
    g = group[ranked]
    later = ranked[np.concatenate(([False], g[1:] == g[:-1]))] if len(g) else ranked
    # an equal place comes from the two parts of one segment, which share no string, so all but the first are later
    marks = where_key[later], where_lo[later], where_lo[later]
    k, a, b = joined_runs(*(np.concatenate(x) for x in zip(copied, marks, strict=True)))
    return pa.table({"key": k, "lo": a, "hi": b})


def by_document(marks: pa.Table) -> pa.Table:
    """Marks as byte spans, one row for each document: (key, n, spans: starts and ends, packed)."""
    key, lo, hi = joined_runs(*(marks[c].to_numpy() for c in ("key", "lo", "hi")))
    key, lo, hi = joined_runs(key, lo, hi + WIDTH - 1)
    cuts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else np.zeros(1, np.int64)
    spans = [np.stack((lo[i:j], hi[i:j] + 1)).tobytes() for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
    return pa.table({"key": key[cuts[:-1]], "spans": pa.array(spans, pa.binary())})


def numbered(df: DataFrame) -> DataFrame:
    """(doc_id, key, text): the key orders the documents. The id itself, if all ids are there and differ."""
    n = df.agg(F.count("*").alias("n"), F.count("doc_id").alias("m"), F.countDistinct("doc_id").alias("k")).first()
    if n["n"] == n["m"] == n["k"] and df.schema["doc_id"].dataType.simpleString() in ("bigint", "int"):
        return df.select("doc_id", F.col("doc_id").cast("long").alias("key"), "text")
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    ranged = df.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return store(ranged.select("doc_id", F.monotonically_increasing_id().alias("key"), "text"), "numbered")


def dedup(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row of ``df`` (doc_id, text)."""
    docs = numbered(df)
    parts = part_count(df)
    lists = segment_lists(docs.select("key", "text"), parts)
    sifted = store(lists.groupBy("part").applyInArrow(sift, "key long, lo long, hi long, place int, f long"), "segments")
    wanted = sifted.where("place >= 0").groupBy("key").agg(F.collect_list(F.struct("lo", "hi", "place")).alias("wanted"))
    wanted = store(wanted, "wanted")
    size = (wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0) * LONGEST
    fetch = docs.select("key", "text").join(wanted, "key")  # both lists grow with the texts, so they are never broadcast
    found = fetched(fetch).groupBy(F.pmod("shard", F.lit(max(parts, size // SHARD_BYTES))).alias("group")).applyInArrow(repeats, "key long, lo long, hi long")
    marks = sifted.where("place < 0").select("key", "lo", "hi").unionByName(found)
    spans = store(marks.groupBy(F.pmod("key", F.lit(parts)).alias("group")).applyInArrow(by_document, "key long, spans binary"), "spans")
    kind = df.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, runs, digest = [], [], [], []
            for text, spans_ in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True):
                text = text or b""
                at = np.frombuffer(spans_ or b"", np.int64).reshape(2, -1)
                kept, last = hashlib.sha256(), 0
                for i, j in at.T.tolist():
                    kept.update(text[last:i])
                    last = j
                kept.update(text[last:])
                n.append(len(text))
                gone.append(int((at[1] - at[0]).sum()))
                runs.append(at.shape[1])
                digest.append(kept.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    met = docs.join(spans, "key", "left").select("doc_id", "text", "spans")
    return small_batches(met).mapInArrow(cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(documents(spark, sf_dir, "doc_id", "text"))
