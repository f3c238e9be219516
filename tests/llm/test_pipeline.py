"""The pipeline against the same steps done plainly in Python."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_decontamination import brute as contaminated
from test_packing import check
from test_pii import brute as spans
from test_simhash import brute as components

SF = "/root/testdata/sf0.001"


def test_stages_are_named_and_return_documents(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash", "decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


SECRET = r"(?<![A-Za-z0-9])(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])[0-9A-Fa-f]{32,}(?![A-Za-z0-9])"


def secrets(text):
    for m in re.finditer(SECRET, text):
        if re.search(r"(?i)token|secret|\bkey|api_?key|passw|credential|bearer", text[max(0, m.start() - 40) : m.start()] + " " + text[m.end() : m.end() + 40]):
            yield m.start(), 6, "secret", m.end()


def redact(text):
    found, out, at = [(a, o, k, b) for a, o, k, b in [*spans(text), *secrets(text)]], [], 0
    for a, _, k, b in sorted(found):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_whole_pipeline_against_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    docs = [(d, t) for d, t in docs if t and re.search(r"[^\W\d_]", t)]
    docs = [x for x in docs if x[0] in {d for d, _, c in components(docs) if d == c}]
    bad = {d for d, *_, hit in contaminated(docs, items) if hit}
    docs = [(d, redact(t)) for d, t in docs if d not in bad]
    n, total = check(docs, corpus_pipeline.run(spark, SF).collect())
    assert n <= -(-total // 2048) + 1


def test_edges(spark, make):
    docs = make([(1, None), (2, ""), (3, "same text here"), (4, "same text here"), (None, "no id at all"), (5, "x" * 5000)])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
    assert sorted({str(r["doc_id"]) for r in docs.collect()}) == ["3", "5", "None"]
    empty = make([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
    assert empty.count() == 0


def test_columns_with_clashing_names_pass_through(spark, make):
    names = ["score", "lang_pred", "fingerprint", "rid", "key", "spans", "kind", "_id", "_text", "a.b", "n", "term", "pos"]
    docs = make([(1, "some text with 1.2.3.4 in it"), (2, "!!"), (3, "other words")])
    for k, c in enumerate(names):
        docs = docs.withColumn(c, F.lit(f"x{k}"))
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
    got = {r["doc_id"]: r for r in docs.collect()}
    assert set(got) == {1, 3} and got[1]["a.b"] == "x9" and got[1]["text"] == "some text with [IP] in it"


def test_stages_drop_the_judged_rows_only(spark, make):
    stages = dict(corpus_pipeline.STAGES)
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 100").first()["text"]
    docs = make([(1, passage), (1, "a clean text of the same id"), (None, passage), (None, "a clean text without an id"), (2, "another clean text")])
    left = stages["decontamination"](spark, docs, SF).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in left) == [("1", "a clean text of the same id"), ("2", "another clean text"), ("None", "a clean text without an id")]
    docs = make([(1, "a b c d")] * 3 + [(4, "a b c d"), (4, "q r s t u"), (7, "v w x y z")] + [(7, "v w x y z")])
    left = stages["simhash"](spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in left) == [(1, "a b c d"), (4, "q r s t u"), (7, "v w x y z")]
