"""The corpus pipeline: language, near copies, benchmark passages, personal data, packing.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; each result is written to the shared folder and
read again as the next stage's documents. All but the last return the columns of ``documents``.

Cases: null and empty texts, and those without a letter, go in the first stage; of repeated rows one stays (rows without
a doc_id all stay); contaminated rows go; personal data is replaced in place; further columns pass through, whatever
their names; an empty table gives no rows. The stages' docstrings say more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import decontamination, language_id, packing, pii, simhash
from quantloom.llm.common import documents, store

STAGES = [
    ("language_id", language_id.stage),
    ("simhash", simhash.stage),
    ("decontamination", decontamination.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]

#: A tokenizer and a trained classifier take part, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
    return docs
