"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1- to 3-grams of the code points (ASCII and Latin-1 capitals folded) of labelled texts
and turns them into a matrix of log probabilities, ``buckets`` x languages: a fixed size for any corpus, so it is
broadcast. Scoring treats a batch of texts as sparse rows over the buckets and multiplies by gather and segment sum
in numpy, block by block, so that one huge text needs no more memory than many small ones. The score is the
posterior probability of the predicted language.

Cases: a null text or one without a letter gets ``und`` and score 0; rows with a null language are not learned
from; with nothing to learn from every row gets ``und``; equal posteriors go to the language first in name order;
repeated rows are counted and scored as often as they occur; an empty table gives no rows; further columns are
ignored, also those named ``lang_pred`` or ``score``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import crc_mod, documents, quoted, row_groups, small_batches, text_bytes

BUCKET_BITS = 15
ORDERS = 3
SMOOTHING = 0.5
#: The classifier is fitted on at most about this many labelled rows, as many of each language, chosen by a hash of
#: their ids; a language with fewer rows than its share gives all of them, and a chosen row's whole text counts.
MAX_TRAINING_ROWS = 20_000
BLOCK = 1 << 18
UND = "und"


@dataclass
class Model:
    langs: list[str]
    prior: np.ndarray  # log, by language
    logp: np.ndarray  # languages x (orders * buckets), float64


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points with two pads before each text (and two at the end), and where each padded text starts."""
    lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    n = len(offsets) - 1
    lengths = np.diff(lead)
    starts = np.concatenate(([0], np.cumsum(lengths + 2)))
    out = np.full(int(starts[-1]) + 2, 32, np.uint32)
    where = np.arange(len(codes)) + 2 * (np.repeat(np.arange(n), lengths) + 1)
    capital = ((codes >= 65) & (codes <= 90)) | ((codes >= 192) & (codes <= 222) & (codes != 215))
    out[where] = codes + 32 * capital.astype(np.uint32)
    return out, starts


def hashed_grams(codes: np.ndarray, order: int, bits: int = BUCKET_BITS) -> np.ndarray:
    """Bucket of the ``order``-gram that starts at each position but the last two, offset by the order's own table."""
    n = len(codes) - 2
    h = codes[:n] * np.uint32(0x9E3779B1)
    if order > 1:
        h = (h ^ codes[1 : n + 1]) * np.uint32(0x85EBCA6B)
    if order > 2:
        h = (h ^ codes[2 : n + 2]) * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - bits)).astype(np.int64) + ((order - 1) << bits)


def blocks(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, code points, starts) of runs of rows, each short enough to hash at once unless a row is longer."""
    for i, j in row_groups(offsets, BLOCK):
        yield (i, *code_points(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))


def pieces(codes: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points in runs of at most BLOCK grams, with the rows that begin in each and the cuts between them."""
    total = int(starts[-1])
    for a in range(0, total, BLOCK):
        b = min(a + BLOCK, total)
        first, last = int(np.searchsorted(starts, a, "right")) - 1, int(np.searchsorted(starts, b, "left"))
        cuts = np.clip(starts[first:last], a, b) - a
        yield codes[a : b + 2], np.arange(first, last), cuts


def class_sums(model_rows: np.ndarray, data: np.ndarray, offsets: np.ndarray, orders: int = ORDERS, bits: int = BUCKET_BITS) -> np.ndarray:
    """texts x rows: the sum over all hashed grams of a text of each row of ``model_rows``."""
    out = np.zeros((len(offsets) - 1, len(model_rows)))
    for i, codes, starts in blocks(data, offsets):
        for part, rows, cuts in pieces(codes, starts):
            for order in range(1, orders + 1):
                h = hashed_grams(part, order, bits)
                for k, weights in enumerate(model_rows):
                    out[i + rows, k] += np.add.reduceat(weights[h], cuts)
    return out


def gram_counts(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray, n_groups: int) -> np.ndarray:
    out = np.zeros((n_groups, ORDERS << BUCKET_BITS), np.int64)
    for g in range(n_groups):
        for r in np.flatnonzero(groups == g):
            cut = np.array([0, offsets[r + 1] - offsets[r]])
            for _, codes, starts in blocks(data[offsets[r] : offsets[r + 1]], cut):
                for part, _, _ in pieces(codes, starts):
                    for order in range(1, ORDERS + 1):
                        h = hashed_grams(part, order)
                        if len(h) > 20_000:
                            out[g] += np.bincount(h, minlength=out.shape[1])
                        else:
                            np.add.at(out[g], h, 1)
    return out


def train(labelled: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Model | None:
    """Fit on rows (doc_id, text, lang); None if there is none with a language and a text."""
    rows = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    known = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    total = sum(known.values())
    if not total:
        return None
    langs = sorted(known)
    if total > max_rows:
        cuts = {x: int(min(1.0, max_rows / len(known) / n) * (1 << 30)) for x, n in known.items()}
        share = F.element_at(F.create_map(*[F.lit(v) for kv in cuts.items() for v in kv]), F.col("lang"))
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share)
    index = {x: k for k, x in enumerate(langs)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(langs), ORDERS << BUCKET_BITS), np.int64)
        for b in batches:
            data, offsets = text_bytes(b.column("text"))
            sums += gram_counts(data, offsets, np.array([index[x] for x in b.column("lang").to_pylist()]), len(langs))
        g, h = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(h.astype(np.int32)), pa.array(sums[g, h])], ["g", "h", "n"])

    counted = small_batches(rows.select("text", "lang")).mapInArrow(count, "g int, h int, n long").groupBy("g", "h").agg(F.sum("n").alias("n")).toPandas()
    sums = np.full((len(langs), ORDERS << BUCKET_BITS), SMOOTHING)
    sums[counted["g"].to_numpy(), counted["h"].to_numpy()] += counted["n"].to_numpy()
    by_order = sums.reshape(len(langs), ORDERS, -1)
    logp = np.log(by_order / by_order.sum(axis=2, keepdims=True)).reshape(len(langs), -1)
    prior = np.log(np.array([known[x] for x in langs], float) / total)
    return Model(langs, prior, logp)


def posteriors(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    s = class_sums(model.logp, data, offsets) + model.prior
    s = np.exp(s - s.max(axis=1, keepdims=True))
    return s / s.sum(axis=1, keepdims=True)


def predict(df: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``df`` (which has a column text), with lang_pred and score."""
    taken = {c: f"_{k}" for k, c in enumerate(keep)}
    seen = df.select(*[F.col(quoted(c)).alias(t) for c, t in taken.items()], F.col("text").alias("_text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters"))
    named = [F.col(t).alias(c) for c, t in taken.items()]
    if model is None:
        return seen.select(*named, F.lit(UND).alias("lang_pred"), F.lit(0.0).alias("score"))
    sent = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([f for f in seen.schema if f.name not in ("_text", "_letters")] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.langs, UND], object)
        for b in batches:
            if not b.num_rows:
                continue
            p = posteriors(m, *text_bytes(b.column("_text")))
            letters = b.column("_letters").to_numpy(zero_copy_only=False)
            best = np.where(letters, p.argmax(axis=1), len(m.langs))
            top = np.where(letters, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([*[b.column(t) for t in taken.values()], pa.array(names[best], pa.string()), pa.array(np.clip(top, 0, 1))], [*taken.values(), "lang_pred", "score"])

    return small_batches(seen).mapInArrow(score, schema).select(*named, "lang_pred", "score")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = train(docs.where(crc_mod("doc_id", 3) != 1))
    return predict(docs, model).withColumn("held_out", crc_mod("doc_id", 3) == 1).select("doc_id", "held_out", "lang_pred", "score")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents whose language cannot be told (``und``: null, empty or without a letter) go.

    It learns from the rows that have a language; repeated rows are judged each; an empty table stays empty.
    """
    found = predict(docs, train(docs), keep=tuple(docs.columns))
    # the operator's own columns come last, so they are addressed by place even where a document column has their name
    return found.toDF(*[f"c{k}" for k in range(len(docs.columns))], "_pred", "_score").where(F.col("_pred") != UND).drop("_pred", "_score").toDF(*docs.columns)
