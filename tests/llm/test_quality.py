import numpy as np

from quantloom.llm import quality as ql

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_accuracy(spark):
    got = ql.op7_quality(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").select("quality", "score", "quality_pred").collect()
    y, s = np.array([r["quality"] for r in got]), np.array([r["score"] for r in got])
    assert len(got) > 30 and auc(y, s) > 0.9
    assert np.mean([r["quality"] == r["quality_pred"] for r in got]) > 0.9


def table_of(spark, content, meta, label, aside):
    rows = [(i, int(y), bool(k), x.astype("<u2").tobytes(), m.astype("<u2").tobytes()) for i, (x, m, y, k) in enumerate(zip(content, meta, label, aside, strict=True))]
    return spark.createDataFrame([(i, y, k, bytearray(x), bytearray(m)) for i, y, k, x, m in rows], "doc_id long, y int, aside boolean, a binary, b binary").repartition(3)


def test_pseudo_labels_help_the_weak_view(spark):
    # the content view separates by words that labelled rows do not hold; the metadata view brings them in
    rng = np.random.default_rng(0)
    n = 600
    y = rng.integers(0, 2, n)
    label = np.where(np.arange(n) < 60, y, -1)
    content = [np.unique(rng.integers(0, 40, 6) + 40 * y[i] + 100 * (i >= 60)).astype(np.int32) for i in range(n)]
    meta = [np.array([100 + y[i] if rng.random() < 0.95 else 101 - y[i], 102 + int(rng.integers(0, 5))], np.int32) for i in range(n)]
    rows = table_of(spark, content, meta, label, (np.arange(n) < 60) & (np.arange(n) % 3 == 0))
    model, none = ql.co_train(rows), ql.co_train(rows, rounds=0)
    views = [m.views(ql.Rows.of(content), ql.Rows.of(meta))[60:, 0] for m in (model, none)]
    assert auc(y[60:], views[0]) > 0.9 > auc(y[60:], views[1])  # all of the pool's words are new to the content view


def brute_rounds(content, meta, label, aside, rounds):
    """Counts that each view learns from after the rounds, row by row."""
    views, sizes = (content, meta), ql.VIEWS
    known = (label >= 0) & ~aside
    share, pool = (label[known] == 1).mean(), label < 0

    def counts(labels):
        out = np.zeros((2, 2, ql.CONTENT + 1), np.int64)
        for v in (0, 1):
            for x, y in zip(views[v], labels[v], strict=True):
                if y >= 0:
                    out[v, y, x] += 1
                    out[v, y, ql.CONTENT] += 1
        return out

    base = counts([np.where(known, label, -1)] * 2)
    sums = base
    for r in range(1, rounds + 1):
        given = []
        for v in (0, 1):
            w = ql.log_odds(sums[v, :, : sizes[v]], sums[v, :, ql.CONTENT])
            step = ql.step_of(np.array([w[x].mean() for x in views[v]]), ql.BINS)
            tally = [np.bincount(step[m], minlength=ql.BINS) for m in (known & (label == 0), known & (label == 1), pool)]
            given.append(np.where(pool, ql.chosen(np.array(tally[:2]), tally[2], ql.GROWTH * r * pool.sum(), share)[step], -1))
        sums = base + counts([given[1], given[0]])
    return sums


def test_rounds_against_brute_force(spark):
    rng = np.random.default_rng(5)
    n = 400
    y = rng.integers(0, 2, n)
    label = np.where(np.arange(n) < 100, y, -1)
    aside = (np.arange(n) < 100) & (np.arange(n) % 4 == 0)
    content = [np.unique(rng.integers(0, 60, 8) + 30 * y[i]).astype(np.int32) for i in range(n)]
    meta = [np.unique(np.array([200 + (y[i] ^ int(rng.random() < 0.1)), 300 + i % 7], np.int32)) for i in range(n)]
    want = ql.weights_of(brute_rounds(content, meta, label, aside, 3))
    model = ql.co_train(table_of(spark, content, meta, label, aside), rounds=3)
    assert np.allclose(model.content, want[0]) and np.allclose(model.meta, want[1])


def test_thresholds_take_whole_steps():
    known = np.zeros((2, ql.BINS), np.int64)
    known[0, :2000], known[1, 2100:] = 5, 5
    pool = np.ones(ql.BINS, np.int64)
    got = ql.chosen(known, pool, 100, 0.5)
    assert (got[-50:] == 1).all() and (got[:50] == 0).all() and (got[50:-50] == -1).all()
    pool[-1] = 10_000  # a crowded step is taken as a whole, and alone
    assert np.flatnonzero(ql.chosen(known, pool, 100, 0.5) == 1).tolist() == [ql.BINS - 1]


def test_logistic_recovers_weights():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20000, 2))
    y = (rng.random(20000) < 1 / (1 + np.exp(-(x @ [1.5, -2.0] + 0.3)))).astype(float)
    assert np.allclose(ql.logistic(x, y, np.ones(len(y))), [1.5, -2.0, 0.3], atol=0.12)


def test_edges(spark, make):
    rows = [(i, f"good calm text number {i}") for i in range(40)] + [(100 + i, f"BAD!! LOUD!! TEXT!! {i}!!") for i in range(40)] + [(300, None), (301, ""), (300, None), (None, "x"), (302, "z" * 200000)]
    docs = make(rows)
    labels = spark.createDataFrame([(i, 1) for i in range(40)] + [(100 + i, 0) for i in range(40)] + [(5, 0), (6, None), (None, 1), (9999, 1)], "doc_id long, y int")
    got = ql.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([(r["score"] > 0.5) == (r["doc_id"] < 100) for r in got if r["doc_id"] is not None and r["doc_id"] < 200]) > 0.95
    assert ql.classify(make([]), labels).collect() == []
    assert {r["score"] for r in ql.classify(docs, labels.where("y = 1")).collect()} == {0.5}
    named = docs.withColumn("doc_id", docs["doc_id"].cast("string")).withColumn("y", docs["n_chars"]).withColumn("key", docs["text"])
    again = ql.classify(named, labels.withColumn("doc_id", labels["doc_id"].cast("string"))).collect()
    assert sorted(round(r["score"], 9) for r in again) == sorted(round(r["score"], 9) for r in got)
