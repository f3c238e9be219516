import hashlib

import numpy as np
import pyarrow as pa
import pytest

from quantloom.llm import substring_dedup as sd


def brute(rows, width=100):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1] is not None, rows[i][1] or ""))
    seen, out = set(), []
    for i in order:
        t = (rows[i][1] or "").encode()
        gone = np.zeros(len(t) + 1, bool)
        for p in range(len(t) - width + 1):
            g = t[p : p + width]
            if g in seen:
                gone[p : p + width] = True
            seen.add(g)
        gone = gone[:-1]
        spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(t) else 0
        out.append((rows[i][0], len(t), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("block,chunk", [(1 << 18, 32 << 20), (1000, 20_000)])
def test_whole_table(spark, make, sample, monkeypatch, block, chunk):
    monkeypatch.setattr(sd, "BLOCK", block)
    monkeypatch.setattr(sd, "CHUNK_BYTES", chunk)
    want = brute(sample)
    assert sum(x[2] for x in want) > 1000
    assert got(sd.dedup(make(sample, 5))) == want


def test_edges(make):
    rng = np.random.default_rng(2)
    word = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    base, line = word(900), word(64)
    rows = [(4, base), (9, base[:450] + "X" + base[450:]), (2, base[300:]), (7, None), (1, ""), (3, "a" * 1000), (5, "ab" * 400), (6, "short"), (8, base), (10, line.join(word(150) for _ in range(6)))]
    rows += [(20 + i, word(80) + line + word(80)) for i in range(30)] + [(60 + i, base[i * 7 : i * 7 + 130] + word(50)) for i in range(40)]
    rows += [(200, word(60) * 20), (201, base * 3)]
    assert got(sd.dedup(make(rows, 4))) == brute(rows)
    assert got(sd.dedup(make([]))) == []
    again = [*rows, (4, base), (4, "other " + base), (None, base), (None, None)]
    assert got(sd.dedup(make(again, 4))) == brute(again)


def test_bytes_decide_what_hashes_propose():
    rng = np.random.default_rng(9)
    data = rng.integers(97, 100, 1000, dtype=np.uint8)
    data[500:700] = data[:200]
    data[599] ^= 1
    a, b = np.array([0, 0, 0, 830]), np.array([500, 500, 500, 830])
    size, sizes = np.array([1, 0 + 69, 20, 69]), np.array([1, 69, 21, 69])
    # the 100th byte differs, sizes differ, and the last one ends beyond the data
    assert sd.equal_segments(data, a, b, size, sizes).tolist() == [False, False, False, True]
    data[599] ^= 1
    assert sd.equal_segments(data, a, b, size, sizes).tolist() == [True, True, False, True]


def test_copies_in_different_tasks_are_left_to_the_suffix_arrays(make, monkeypatch):
    rng = np.random.default_rng(12)
    text = "".join(rng.choice(list("abcdefgh "), 3000))
    rows = [(i, text) for i in range(12)]
    want = brute(rows)
    assert got(sd.dedup(make(rows, 4))) == want
    blind = lambda parts: pa.table({"key": pa.array([], pa.int64()), "lo": pa.array([], pa.int64()), "hi": pa.array([], pa.int64())})
    monkeypatch.setattr(sd, "repeats", blind)
    left = sum(r[2] == 0 for r in got(sd.dedup(make(rows, 4))))
    assert left > 1  # without them one copy of each task would stay


def test_segments_depend_on_content_only():
    rng = np.random.default_rng(1)
    common = bytes(rng.integers(97, 105, 400, dtype=np.uint8))
    texts = [common, b"some other text before it " * 5 + common]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.array([0, 400, len(data)])
    f, h, row, lo, n, place = (np.concatenate(x) for x in zip(*sd.segments(data, offsets)))
    assert n[row == 0].sum() == 301 and n[row == 1].sum() == len(texts[1]) - 99
    assert len(set(zip(f[row == 0], h[row == 0])) & set(zip(f[row == 1], h[row == 1]))) >= (row == 0).sum() - 2


def test_shards_compare_every_string():
    rng = np.random.default_rng(4)
    text = bytes(rng.integers(97, 100, 168, dtype=np.uint8))
    for place in range(69):
        for hi in range(place, 69):
            # strings from 0 to hi with the anchor at `place` after the first
            strings = [p for a, b, _ in sd.halves(text, 0, min(hi, place), place) for p in range(a, b + 1)]
            assert strings == list(range(min(hi, place) + 1))
    t = pa.table({"shard": pa.array([1, 1, 2]), "key": pa.array([5, 3, 9]), "lo": pa.array([10, 20, 0]), "bytes": pa.array([text[:130], text[5:130], text], pa.binary())})
    out = sd.repeats(t).to_pydict()
    assert out == {"key": [5], "lo": [15], "hi": [40]}
