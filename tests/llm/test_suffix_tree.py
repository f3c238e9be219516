import math
from collections import Counter

import numpy as np

from quantloom.llm import suffix_tree as st
from quantloom.llm.common import py_crc_mod

SF = "/root/testdata/sf0.001"
START, END = "<start>", "<end>"


def tokens(t):
    return (t or "").encode().lower().split()


def brute(rows, depth=st.DEPTH, least=st.LEAST_COUNT, divergence=st.DIVERGENCE):
    """rows of (doc_id, text, train) -> (doc_id, train, n_tokens, n_known, train_tokens, base_score, score), by dictionaries."""
    follow, c = {}, Counter()
    for _, t, train in rows:
        s = [START, *tokens(t), END]
        for i in range(1, len(s) if train else 0):
            c[s[i]] += 1
            for d in range(1, min(i, depth) + 1):
                follow.setdefault(tuple(s[i - d : i]), Counter())[s[i]] += 1
    n, v = sum(c.values()), len(c)
    smooth = {k: x for k, x in follow.items() if sum(x.values()) >= least}

    def p(context, w):
        if not context:
            return (c[w] + 1) / (n + v + 1)
        if context not in smooth:
            return p(context[1:], w)
        x = smooth[context]
        return (x[w] + len(x) * p(context[1:], w)) / (sum(x.values()) + len(x))

    kept = set()
    for context, x in smooth.items():
        total = sum(x.values())
        if sum(k * math.log(k / total / p(context[1:], w)) for w, k in x.items()) >= divergence * len(x):
            kept.add(context)
    out = []
    for d, t, train in rows:
        s = [START, *tokens(t), END]
        score = 0.0
        for i in range(1, len(s)):
            state = next((tuple(s[i - k : i]) for k in range(min(i, depth), 0, -1) if tuple(s[i - k : i]) in kept), ())
            score += math.log10(p(state, s[i]))
        out.append((d, train, len(s) - 1, sum(c[w] > 0 for w in s[1:]), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in s[1:]), score))
    return sorted(out, key=str), len(kept)


def got(df):
    return sorted(((r["doc_id"], r["train"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in df.collect()), key=str)


def same(a, b):
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert np.allclose([x[5] for x in a], [x[5] for x in b], rtol=1e-9, atol=1e-9)
    assert np.allclose([x[6] for x in a], [x[6] for x in b], rtol=1e-9, atol=1e-9)


def test_whole_table_against_brute_force(spark, sample):
    from pyspark.sql import functions as F

    rows = [(d, t, py_crc_mod(d, 7) != 2) for d, t in sample]
    want, kept = brute(rows)
    assert kept > 100
    same(got(st.op1_suffix_tree(spark, SF).withColumn("train", ~F.col("held_out"))), want)


def test_depth_and_chunks_against_brute_force(spark, sample, monkeypatch):
    rows = [(i, t, i % 4 != 0) for i, (_, t) in enumerate(sample[:80])] + [(900 + i, t, True) for i, (_, t) in enumerate(sample[:20])]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(5)
    for depth, least, divergence in ((3, 2, 0.5), (2, 3, 4.0), (4, 2, 0.0)):
        want, kept = brute(rows, depth, least, divergence)
        assert kept > 50
        same(got(st.score(df, depth, least, divergence)), want)


def test_probabilities_of_next_symbols_sum_to_one(spark, sample):
    texts = [" ".join(t.split()[:40]) for _, t in sample[:30]]
    words = sorted({w.decode() for t in texts for w in tokens(t)})
    stem = " ".join(texts[0].split()[:6])
    rows = [(i, t, True) for i, t in enumerate(texts * 3)]
    asked = [*(f"{stem} {w}" for w in words), f"{stem} zzz-unknown"]
    df = spark.createDataFrame([*rows, *((1000 + i, t, False) for i, t in enumerate(asked)), (999, stem, False)], "doc_id long, text string, train boolean")
    score = {r[0]: r for r in brute([(r["doc_id"], r["text"], r["train"]) for r in df.collect()])[0]}
    found = {r[0]: r for r in got(st.score(df))}
    assert all(math.isclose(found[k][6], score[k][6], rel_tol=1e-9) for k in score)


def test_edges(spark):
    rows = [(1, None, True), (2, "", True), (3, "The the THE", True), (3, "The the THE", True), (4, "unseen é É", False), (None, "the \t\n end", True), (6, "a\x00b   c", True)]
    rows += [(10 + k, "z" * (10_000 << k), False) for k in range(5)] + [(20, "y" * 200_000 + " the", True), (21, "w " * 100_000, True), (22, "w " * 70_000, False)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean").repartition(2)
    found = got(st.score(df))
    same(found, brute(rows)[0])
    assert all(r[6] < 0 for r in found)
    assert st.score(df.limit(0)).collect() == []
    none = st.score(df.where("not train")).collect()
    assert all(r["train_tokens"] == 0 and r["base_score"] == 0 and r["score"] == 0 and r["n_known"] == 0 for r in none) and none


def test_text_ids_and_clashing_columns(spark):
    rows = [("b", "one two", True, 5, "x"), ("a", "one three", False, 6, "y")]
    df = spark.createDataFrame(rows, "doc_id string, text string, train boolean, chunk int, part string")
    same(got(st.score(df)), brute([r[:3] for r in rows])[0])


def test_held_out_texts_teach_nothing(spark):
    rows = [(i, f"alpha beta w{i}", True) for i in range(20)] + [(99, "alpha beta", True)]
    schema = "doc_id long, text string, train boolean"
    a = {r[0]: r for r in got(st.score(spark.createDataFrame(rows, schema)))}
    b = {r[0]: r for r in got(st.score(spark.createDataFrame([*rows, (100, "secret words " * 50, False)], schema)))}
    assert all(np.allclose(a[k][4:], b[k][4:]) for k in a)


def test_contexts_beat_the_base_on_held_out_texts(spark):
    r = st.op1_suffix_tree(spark, "/root/testdata/sf0.01").where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r["s"] > 0.95 * r["b"]


def test_places_in_order():
    for key in ([], [5], [3, 1, 3, 0, 1], [2**62, 7, 2**62, 0]):
        key = np.array(key, np.int64)
        values, first, inv = st.distinct(key)
        assert values.tolist() == sorted(set(key.tolist()))
        assert key[first].tolist() == values.tolist() and values[inv].tolist() == key.tolist()


def test_parts_send_sums_only_of_what_they_cannot_tell(spark, sample):
    df = spark.createDataFrame([(i, t, True) for i, (_, t) in enumerate(sample)], "doc_id long, text string, train boolean").coalesce(1)
    told = st.Told(4, {}, tokens=sum(len(tokens(t)) + 1 for _, t in sample), kinds=1 + len({w for _, t in sample for w in tokens(t)}))
    (row,) = [r.asDict() for r in st.chunked(df).collect()]

    def answers(level, rows):
        return [st.summed(level, rows.slice(k, 1)).to_pylist()[0] for k in range(rows.num_rows)]

    chunk = st.Chunk(told, row)
    chunk.walk({1: answers(1, chunk.first_rows())}, 1)
    x, rows = chunk.level, chunk.rows()
    turns = [chunk.rows(k, 2) for k in range(2)]
    assert sorted(r["part"] for t in turns for r in t.to_pylist()) == rows["part"].to_pylist() and all(t.num_rows == 2 for t in turns)
    found = answers(2, rows)
    alone = np.bincount(x.entry, minlength=len(x.part)) == 0  # contexts of one symbol, of which only sums are listed
    assert 0 < alone.sum() < len(x.part)
    assert not any(len(st.unpack(r["gain"])) for r in found)  # no context is shared among these parts
    total, kinds, gain, sure, n = x.heard(found)
    size = len(chunk.names)
    want = st.retained(chunk.totals, kinds[:size], sums(chunk, x)[:size], told.divergence)
    assert np.array_equal(sure[:size], want) and 0 < want.sum() < size


def sums(chunk, x):
    """Of each context: the sum of n * (log n - log p of the next symbol in the shorter state), with the sums as sent."""
    own = np.bincount(x.context, weights=x.n * np.log(np.maximum(x.n, 1)), minlength=int(x.owner.max()) + 1)
    return own - np.bincount(x.owner, weights=chunk.sums.astype(np.float32), minlength=len(own))
