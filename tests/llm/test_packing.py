import zlib

import numpy as np
from tokenizers import Tokenizer

from quantloom.llm import packing


def check(rows, out, size=2048):
    tokens = Tokenizer.from_file(packing.default_vocabulary())
    want = {}
    for d, t in rows:
        ids = [*tokens.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= size else len(ids) % size or size
        for p, (a, b) in enumerate([(0, first), *((x, x + size) for x in range(first, len(ids), size))]):
            want.setdefault((d, p), []).append((a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got, places = {}, {}
    for r in out:
        got.setdefault((r["doc_id"], r["piece"]), []).append((r["start"], r["length"], r["ids_crc32"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= size
    return len(places), sum(n for v in want.values() for _, n, _ in v)


def test_round_trip_and_fill(make, sample):
    n, total = check(sample, packing.pack(make(sample)).collect())
    assert n <= -(-total // 2048) + 1


def test_edges(make):
    rows = [(1, None), (2, ""), (3, "x" * 30000), (4, "a <|endoftext|> b"), (5, "word " * 2047), (6, "word " * 4096), (7, "same"), (7, "same"), (None, "no id"), (8, "日本語 🙂 " * 50), (9, "\n" * 5000)]
    check(rows, packing.pack(make(rows)).collect())
    assert packing.pack(make([])).collect() == []


def test_same_ids_as_the_tokenizers_library(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    e = packing.Encoder(packing.default_vocabulary())
    slow = e.slow.encode_batch(texts, add_special_tokens=False)
    assert all(e.fast.encode_ordinary(t) == s.ids for t, s in zip(texts, slow, strict=True))


def test_sweep_is_best_fit():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 2049, 3000).tolist() + [700] * 900 + [1] * 50
    runs = {}
    for s in sizes:
        runs[s] = runs.get(s, 0) + 1
    gaps = []
    for s in sorted(sizes, reverse=True):
        fit = min((g for g in gaps if g >= s), default=None)
        if fit is None:
            gaps.append(2048 - s)
        else:
            gaps.remove(fit)
            if fit > s:
                gaps.append(fit - s)
            else:
                gaps.append(0)
    plan = packing.sweep(runs)
    assert len({int(x) for row in plan for x in range(row[3], row[3] + row[2])}) <= len(gaps)
    for s, n in runs.items():
        mine = plan[plan[:, 0] == s]
        assert sorted(x for r in mine for x in range(r[1], r[1] + r[2])) == list(range(n))
