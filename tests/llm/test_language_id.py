import numpy as np

from quantloom.llm import language_id
from quantloom.llm.common import text_bytes


def test_held_out_accuracy(spark):
    out = language_id.op2_language_id(spark, "/root/testdata/sf0.01").where("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    n, right = out.count(), out.where("lang = lang_pred").count()
    assert right >= 0.98 * n


def test_edges(spark, make):
    model = language_id.train(spark.createDataFrame([(1, "the and of", "en"), (2, "der die das", "de"), (3, "x", None), (4, None, "en")], "doc_id long, text string, lang string"))
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, "the of"), (4, "the of"), (5, "die das " * 300000), (None, "the")]
    out = {(r["doc_id"], r["lang_pred"], r["score"] > 0.5) for r in language_id.predict(make(rows), model).collect()}
    assert out == {(1, "und", False), (2, "und", False), (3, "und", False), (4, "en", True), (5, "de", True), (None, "en", True)}
    assert language_id.predict(make([]), model).collect() == []
    assert language_id.train(make([]).select("doc_id", "text", "lang")) is None
    assert {r["lang_pred"] for r in language_id.predict(make(rows), None).collect()} == {"und"}


def test_a_rare_language_keeps_its_training_rows(spark):
    rows = [(i, "the and of it", "en") for i in range(400)] + [(1000 + i, "der die das und", "de") for i in range(3)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=40)
    assert model.langs == ["de", "en"]
    out = language_id.predict(spark.createDataFrame([(1, "der das")], "doc_id long, text string"), model).first()
    assert out["lang_pred"] == "de"


def test_sparse_scores_against_brute_force(sample, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(language_id, "BLOCK", 1000)
    texts = [t for _, t in sample[:20]] + ["", "é"]
    data, offsets = text_bytes(pa.array(texts))
    rng = np.random.default_rng(0)
    rows = rng.random((2, language_id.ORDERS << language_id.BUCKET_BITS))
    got = language_id.class_sums(rows, data, offsets)
    for t, g in zip(texts, got, strict=True):
        codes, _ = language_id.code_points(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        want = sum(rows[:, language_id.hashed_grams(codes, k)].sum(axis=1) for k in (1, 2, 3))
        assert np.allclose(g, want)


def test_stage_returns_documents(spark, make):
    out = language_id.stage(spark, make([(1, "the of"), (2, "!!"), (3, None), (3, "and")]), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3]
