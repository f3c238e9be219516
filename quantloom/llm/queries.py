"""The corpus queries by name, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quantloom.llm import decontamination, topk
from quantloom.llm.decontamination import op4_decontamination
from quantloom.llm.language_id import op2_language_id
from quantloom.llm.packing import op9_packing
from quantloom.llm.pii import op8_pii
from quantloom.llm.quality import op7_quality
from quantloom.llm.sharding import op3_sharding
from quantloom.llm.simhash import op6_simhash
from quantloom.llm.substring_dedup import op5_suffix_dedup
from quantloom.llm.suffix_tree import op1_suffix_tree
from quantloom.llm.topk import op10_topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_tree": op1_suffix_tree,
        "op2_language_id": op2_language_id,
        "op3_sharding": op3_sharding,
        "op4_decontamination": op4_decontamination,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_simhash": op6_simhash,
        "op7_quality": op7_quality,
        "op8_pii": op8_pii,
        "op9_packing": op9_packing,
        "op10_topk": op10_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontamination": decontamination.ORACLE_SQL, "op10_topk": topk.ORACLE_SQL}
