import math

import duckdb
import numpy as np

from quantloom.llm import topk

SF = "/root/testdata/sf0.01"


def brute(rows, k=5, every=50):
    good = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i % every == 0:
            met = sorted((-sum(x * y for x, y in zip(q, v)), j) for b, (j, v) in enumerate(good) if b != a and len(v) == len(q))
            out += [(i, r + 1, j, max(-(1 << 63), min(-s, (1 << 63) - 1))) for r, (s, j) in enumerate(met[:k])]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert got(topk.op10_topk(spark, SF)) == sorted(con.sql(topk.ORACLE_SQL).fetchall())


def test_edges(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(140)]
    rows += [(i, [1.0, 0.0, -1.0, 0.5]) for i in (150, 151, 152, 200, 200)]
    rows += [(250, None), (300, [1.0, None, 0.0, 0.0]), (350, [float("nan"), 0.0, 0.0, 0.0]), (400, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.0] * 4)]
    rows += [(450, [1.0, 2.0]), (451, [0.5, 0.5]), (500, [7.0]), (550, []), (551, []), (600, [1e30, -1e30]), (601, [1e300, 1.0]), (-50, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(topk, "BLOCK", 40)
    monkeypatch.setattr(topk, "CHUNK", 2)
    assert got(topk.top_k(df)) == brute(rows)
    assert got(topk.top_k(df.limit(0))) == []


def test_bitmap_sums_and_boundary():
    rng = np.random.default_rng(0)
    exact = rng.integers(-300, 300, (1000, 16))
    block = topk.Block(np.arange(1000), np.arange(1000), exact)
    for _ in range(20):
        q = rng.integers(-200, 200, 16)
        kept = (exact - exact.min(axis=0)) >> block.drop
        top = (1 << block.bits) - 1
        want = np.where(q < 0, (top - kept) * -q, kept * q).sum(axis=1)
        sums = block.sums(q)
        flat = sum(np.unpackbits(s.view(np.uint8), bitorder="little")[:1000].astype(np.int64) << b for b, s in enumerate(sums))
        assert (flat == want).all()
        best = set(np.argsort(-(exact @ q), kind="stable")[:6].tolist())
        assert best <= set(block.boundary(q, 6).tolist()) and len(block.boundary(q, 6)) < 600
