"""Quality classification by co-training two views of a page.

The content view holds the words of a text and the last two bytes of each, hashed; the metadata view holds what the
page is filed under (source, language, length) and how it is laid out (shares of capitals, digits, symbols and line
breaks), in steps. Each view has a naive Bayes classifier over the presence of its features. They start from labelled
rows; in each round either one labels the unlabelled rows of the whole corpus that it is surest of, and these teach the
other in the next. At last each view's score is calibrated (Platt) on labelled rows kept aside, a logistic combination
of the two calibrated views is fitted on the same rows, and it scores every document.

Features are computed once and stored. All labelled and all unlabelled rows take part: what the driver sees are sums
of a fixed size, namely counts by feature, and counts of rows by class and by ``BINS`` steps of a score, from which
thresholds (distributed quantiles) and calibrations are taken. A round of co-training is one pass for the steps and
one for the counts of the rows chosen. The rows a view chooses are chosen anew in each round, a larger share each time,
and a step of the score is chosen as a whole; the surest step always is, if it is sure enough.

Cases: a null or empty text has metadata alone; null metadata is a value of its own; a document with labels that
contradict each other evenly is not labelled; labels without a document, or null, are ignored; rows without a doc_id
are unlabelled; without labels of both kinds every score is 0.5; repeated rows are each scored; an empty table gives
no rows; ids may have any type; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import bounded, crc_mod, segment_sums, small_batches, store, table

CONTENT = 1 << 14
META = 1 << 10
ROUNDS = 5
#: By how much of the pool what either view may label grows with each round, and how sure it must be.
GROWTH = 0.04
SURE = 0.9
#: Steps of a view's score between -REACH and REACH, and of each of the two where they are combined.
BINS = 4_096
BINS_EACH = 256
REACH = 8.0

_CLASS = np.zeros(256, np.uint8)  # 0 letters and other bytes, 1 capitals, 2 digits, 3 symbols, 4 white space, 5 line ends
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 3
_CLASS[65:91], _CLASS[48:58] = 1, 2
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10] = 4, 5


def content_features(raw: bytes) -> np.ndarray:
    words = raw.lower().split()
    crc, mask = zlib.crc32, CONTENT - 1
    return np.unique(np.array([*(crc(w) & mask for w in words), *(crc(w[-2:], 1) & mask for w in words)], np.int32))


def meta_features(raw: bytes, source: str | None, lang: str | None, n_chars: int | None) -> np.ndarray:
    count = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=6)
    steps = [int(np.log2(c / max(1, len(raw)) + 2.0**-12)) for c in count[1:]]
    told = [f"source {source}", f"lang {lang}", f"length {None if n_chars is None else max(0, n_chars).bit_length()}", *(f"{k} {s}" for k, s in enumerate(steps))]
    return np.unique(np.array([zlib.crc32(t.encode()) & (META - 1) for t in told], np.int32))


def featured(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    raw = batch.column("text").cast(pa.binary()).to_pylist()
    for text, source, lang, n in zip(raw, *(batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")), strict=True):
        yield content_features(text or b""), meta_features(text or b"", source, lang, n)


@dataclass
class Rows:
    """Sparse rows of a view: feature ids and cuts."""

    ids: np.ndarray
    cuts: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Rows:
        return cls(np.concatenate([np.zeros(0, np.int32), *rows]), np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int64))

    def mean(self, weights: np.ndarray) -> np.ndarray:
        return segment_sums(weights[self.ids], self.cuts) / np.maximum(1, np.diff(self.cuts))


def log_odds(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log odds of each feature's presence, from its counts in rows of class 0 and 1 and the numbers of these rows."""
    return np.log((counts[1] + 1) / (n[1] + 2)) - np.log((counts[0] + 1) / (n[0] + 2))


def logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> np.ndarray:
    """Weights of a logistic regression with intercept (last) on rows that occur ``n`` times, by Newton's method."""
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + penalty, x.T @ (n * (y - p)) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    content: np.ndarray
    meta: np.ndarray
    platt: tuple[np.ndarray, np.ndarray]
    both: np.ndarray

    def views(self, content: Rows, meta: Rows) -> np.ndarray:
        return np.column_stack([p[0] * r.mean(w) + p[1] for r, w, p in ((content, self.content, self.platt[0]), (meta, self.meta, self.platt[1]))])

    def score(self, content: Rows, meta: Rows) -> tuple[np.ndarray, np.ndarray]:
        v = np.clip(self.views(content, meta), -8, 8)
        return sigmoid(v), sigmoid(v @ self.both[:2] + self.both[2])


# ---- the table of features -------------------------------------------------------------------------------------


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, y, aside, a, b) of all rows of ``docs``, stored: the label (-1: none), and the features of both views.

    ``labels`` has (doc_id, y); a fifth of the labelled ids are kept aside.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(featured(b))
            packed = [pa.array([x[k].astype("<u2").tobytes() for x in rows], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *packed], ["doc_id", "a", "b"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    clear = labels.where("y is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("y").alias("y")).where("y <> 0.5").select("doc_id", (F.col("y") > 0.5).cast("int").alias("y"))
    clear = bounded(store(clear, "labels"))
    made = small_batches(docs.select("doc_id", "text", "source", "lang", "n_chars")).mapInArrow(run, f"doc_id {kind}, a binary, b binary")
    # rows without an id meet no label; a key of their own each keeps them from meeting in one task
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.xxhash64("a", "b").cast("string"), F.lit("?")))
    met = made.withColumn("key", key).join(clear.select(F.col("doc_id").cast("string").alias("key"), "y"), "key", "left")
    return store(met.select("doc_id", F.coalesce("y", F.lit(-1)).alias("y"), (crc_mod("doc_id", 5) == 0).alias("aside"), "a", "b"), "features")


def rows_of(batch: pa.RecordBatch) -> tuple[Rows, Rows]:
    def view(column: str) -> Rows:
        raw = batch.column(column)
        return Rows.of([np.frombuffer(x, "<u2").astype(np.int32) for x in raw.to_pylist()])

    return view("a"), view("b")


def step_of(s: np.ndarray, steps: int) -> np.ndarray:
    return np.minimum(((np.clip(s, -REACH, REACH) + REACH) / (2 * REACH) * steps).astype(np.int64), steps - 1)


def middle(steps: int) -> np.ndarray:
    return (np.arange(steps) + 0.5) / steps * 2 * REACH - REACH


def tallied(rows: DataFrame, shape: tuple[int, ...], tally) -> np.ndarray:
    """Sums of a fixed shape over all rows: each task adds up its own, ``tally(batch, sums)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(shape, np.int64)
        for b in batches:
            tally(b, sums)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(sums.ravel()[at])], ["at", "n"])

    out = np.zeros(int(np.prod(shape)), np.int64)
    got = small_batches(rows).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    out[got["at"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return out.reshape(shape)


VIEWS = (CONTENT, META)


def add_rows(sums: np.ndarray, views: tuple[Rows, Rows], labels: tuple[np.ndarray, np.ndarray]) -> None:
    """Count features by view and class; the last column has the rows."""
    for v, (rows, y, size) in enumerate(zip(views, labels, VIEWS, strict=True)):
        each = np.repeat(y, np.diff(rows.cuts))
        for k in (0, 1):
            sums[v, k, :size] += np.bincount(rows.ids[each == k], minlength=size)
            sums[v, k, CONTENT] += int((y == k).sum())


def weights_of(sums: np.ndarray) -> list[np.ndarray]:
    return [log_odds(sums[v, :, :size], sums[v, :, CONTENT]) for v, size in enumerate(VIEWS)]


def chosen(known: np.ndarray, pool: np.ndarray, most: float, share: float) -> np.ndarray:
    """Of each step of a view's score the label it gives (-1: none), from the known rows by class and the pool's, by step."""
    x, n = middle(BINS), known
    w = logistic(np.concatenate((x, x))[:, None], np.repeat([0.0, 1.0], BINS), np.concatenate((n[0], n[1])).astype(float))
    odds = w[0] * x + w[1]
    out = np.full(BINS, -1, np.int8)
    for want, sure, part in ((1, odds, share), (0, -odds, 1 - share)):
        order = np.argsort(-sure, kind="stable")
        order = order[(sigmoid(sure[order]) >= SURE) & (pool[order] > 0)]
        upto = np.cumsum(pool[order]) <= most * part
        upto[:1] = True
        out[order[upto]] = want
    return out


def co_train(rows: DataFrame, rounds: int = ROUNDS) -> Model | None:
    """The model of all rows (y, aside, a, b) of a table of :func:`features`."""

    def known(b: pa.RecordBatch) -> np.ndarray:
        return np.where(b.column("aside").to_numpy(zero_copy_only=False), -1, b.column("y").to_numpy())

    def labelled(b: pa.RecordBatch, sums: np.ndarray) -> None:
        y = known(b)
        at = pa.array(np.flatnonzero(y >= 0))
        add_rows(sums, rows_of(b.take(at)), (y[y >= 0],) * 2)

    shape = (2, 2, CONTENT + 1)
    mine = rows.where("y >= 0 and not aside")
    base = tallied(mine, shape, labelled)
    sides = {r["y"]: r["count"] for r in rows.where("y >= 0 and aside").groupBy("y").count().collect()}
    if not base[0, :, CONTENT].all() or len(sides) < 2:
        return None
    share = base[0, 1, CONTENT] / base[0, :, CONTENT].sum()
    n_pool = rows.where("y < 0").count()
    sums = base
    for r in range(1, rounds + 1):
        weights = weights_of(sums)

        def by_step(b: pa.RecordBatch, out: np.ndarray, weights=weights) -> None:
            kind = np.where(b.column("y").to_numpy() < 0, 2, known(b))
            for v, view in enumerate(rows_of(b)):
                step = step_of(view.mean(weights[v]), BINS)
                for k in (0, 1, 2):
                    out[v, k] += np.bincount(step[kind == k], minlength=BINS)

        steps = tallied(rows, (2, 3, BINS), by_step)
        given = [chosen(x[:2], x[2], GROWTH * r * n_pool, share) for x in steps]

        def taught(b: pa.RecordBatch, out: np.ndarray, weights=weights, given=given) -> None:
            views = rows_of(b)
            told = [g[step_of(x.mean(w), BINS)] for g, x, w in zip(given, views, weights, strict=True)]
            add_rows(out, views, (told[1], told[0]))  # what one view is sure of teaches the other

        sums = base + tallied(rows.where("y < 0"), shape, taught)
    weights = weights_of(sums)

    def together(b: pa.RecordBatch, out: np.ndarray) -> None:
        step = [step_of(x.mean(w), BINS_EACH) for x, w in zip(rows_of(b), weights, strict=True)]
        np.add.at(out, (b.column("y").to_numpy(), *step), 1)

    aside = tallied(rows.where("y >= 0 and aside"), (2, BINS_EACH, BINS_EACH), together)
    y, i, j = np.nonzero(aside)
    n = aside[y, i, j].astype(float)
    x = middle(BINS_EACH)
    platt = tuple(logistic(x[at][:, None], y.astype(float), n) for at in (i, j))
    model = Model(weights[0], weights[1], platt, np.zeros(3))
    calibrated = np.column_stack([p[0] * x[at] + p[1] for p, at in zip(platt, (i, j), strict=True)])
    model.both = logistic(np.clip(calibrated, -8, 8), y.astype(float), n)
    return model


def scored(rows: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, p_content, p_meta and score (the probability of good quality) of every row of a table of :func:`features`."""
    if model is None:
        return rows.select("doc_id", *[F.lit(0.5).alias(c) for c in ("p_content", "p_meta", "score")])
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            views, score = sent.value.score(*rows_of(b))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(views[:, 0]), pa.array(views[:, 1]), pa.array(score)], ["doc_id", "p_content", "p_meta", "score"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return small_batches(rows.select("doc_id", "a", "b")).mapInArrow(run, f"doc_id {kind}, p_content double, p_meta double, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on ``docs`` (doc_id, text, source, lang, n_chars) and ``labels`` (doc_id, y), and score every row of ``docs``."""
    rows = features(docs, labels)
    return scored(rows, co_train(rows))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; those whose crc32(doc_id) mod 7 is 3 lend no label, for an honest test."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source", "lang", "n_chars")
    labels = table(spark, sf_dir, "labels").where(crc_mod("doc_id", 7) != 3).select("doc_id", F.col("quality").alias("y"))
    out = classify(docs, labels)
    return out.select("doc_id", (crc_mod("doc_id", 7) == 3).alias("held_out"), "p_content", "p_meta", "score", (F.col("score") >= 0.5).cast("int").alias("quality_pred"))
