import hashlib
import re

import duckdb

from quantloom.llm import decontamination as dc

SF = "/root/testdata/sf0.001"


def split(t):
    t = (t or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(docs, items, window=13):
    wins = []
    for i, t in items:
        w = split(t)
        n = min(window, len(w))
        wins += [(i, tuple(w[s : s + n])) for s in range(len(w) - n + 1)] if w else []
    out = []
    for d, t in docs:
        w = split(t)
        hit, met = set(), set()
        for i, win in wins:
            for s in range(len(w) - len(win) + 1):
                if tuple(w[s : s + len(win)]) == win:
                    hit |= set(range(s, s + len(win)))
                    if i is not None:
                        met.add(str(i))
        out.append((d, len(w), len(hit), len(met), hashlib.sha256(",".join(sorted(met)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)


def test_whole_table_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert got(dc.op4_decontamination(spark, SF)) == sorted(con.sql(dc.ORACLE_SQL).fetchall(), key=str)


def test_query_has_the_columns_of_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, df = con.sql(dc.ORACLE_SQL), dc.op4_decontamination(spark, SF)
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_edges(spark, make):
    long = " ".join(f"w{i}" for i in range(30))
    items = [(1, long), (10, "Short item"), (2, None), (3, "..."), (None, "null id words"), (1, "second row of one"), (7, "a a a a a a a a a a a a a a a"), (8, "é")]
    docs = [(1, None), (2, ""), (3, long.upper()), (4, "x " + long[:60] + " y"), (5, "short ITEM, short item."), (5, "short item"), (6, "null-id words"), (None, "second row of one"), (7, "a " * 40), (8, "É é"), (9, "filler " * 5000 + long), (11, "w0 " * 13)]
    ik = spark.createDataFrame([(i, t) for i, t in items], "item_id long, text string")
    assert got(dc.decontaminate(make(docs), ik)) == brute(docs, items)
    assert got(dc.decontaminate(make([]), ik)) == []
    assert got(dc.decontaminate(make(docs[:3]), ik.limit(0))) == brute(docs[:3], [])


def test_proximity(spark, make):
    docs = make([(1, "alpha x beta"), (2, "alpha x x x x beta"), (3, "beta alpha"), (4, "alpha")])
    q = spark.createDataFrame([(9, "alpha"), (9, "beta"), (8, "gamma"), (8, "alpha")], "query long, term string")
    index = dc.build_index(docs)
    heads = index.where("term = ''").select("rid", "doc_id")
    near = dc.proximity(index, q, 2).join(heads, "rid")
    assert sorted((r["doc_id"], r["query"]) for r in near.collect()) == [(1, 9), (3, 9)]


def test_near_counts_items_by_their_rarest_terms(spark, make):
    docs = make([(1, "alpha w w beta w gamma"), (2, "gamma " + "w " * 30 + "alpha beta"), (3, "alpha beta"), (4, None)])
    items = spark.createDataFrame([(1, "beta w alpha w gamma w"), (2, "alpha beta"), (3, "nowhere alpha"), (4, None)], "item_id long, text string")
    assert {r["doc_id"]: r["n_near"] for r in dc.decontaminate(docs, items).collect()} == {1: 2, 2: 1, 3: 1, 4: 0}


def test_terms_too_many_to_broadcast(spark, make, sample, monkeypatch):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    want = got(dc.decontaminate(make(sample), items))
    monkeypatch.setattr(dc, "small", lambda df: False)
    monkeypatch.setattr(dc, "bounded", lambda df: df)
    assert got(dc.decontaminate(make(sample), items)) == want


def test_stage_drops_contaminated_only(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bad = {r["doc_id"] for r in dc.op4_decontamination(spark, SF).where("contaminated").collect()}
    out = dc.stage(spark, docs, SF)
    assert out.columns == docs.columns and bad
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()} - bad
