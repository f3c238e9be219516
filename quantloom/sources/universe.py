"""Reference tables: companies, priced symbols, static weights and flags, overrides."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.sources.xlsx import read_sheet


def reference_companies(spark: SparkSession, path: str, sheet: str = "Industry Exposure Matrix") -> DataFrame:
    """(symbol, company_name, ord): distinct companies of a workbook, in the order of its rows."""
    rows = read_sheet(spark, path, sheet)
    named = rows.select("row", F.col("cells")["Symbol"].alias("symbol"), F.col("cells")["Company Name"].alias("company_name"))
    return named.groupBy("symbol", "company_name").agg(F.min("row").alias("ord"))


def priced_symbols(spark: SparkSession, path: str) -> DataFrame:
    """(symbol) of an availability file, those marked OK."""
    return spark.read.csv(path, header=True).where("Status = 'OK'").select(F.col("Symbol").alias("symbol")).distinct()


def industry_weights(spark: SparkSession, path: str, universe: DataFrame, columns: list[str], sheet: str = "Industry Exposure Matrix") -> DataFrame:
    """(symbol, columns...): a row for every symbol of the universe, null where the workbook has none."""
    rows = read_sheet(spark, path, sheet).select(F.col("cells")["Symbol"].alias("symbol"), *[F.col("cells")[c].try_cast("double").alias(c) for c in columns])
    return universe.select("symbol").join(rows, "symbol", "left")


def static_flags(spark: SparkSession, path: str, universe: DataFrame, name: str = "is_psu") -> DataFrame:
    """(symbol, flag): 0 where the file has none."""
    rows = spark.read.csv(path, header=True).select(F.col("Symbol").alias("symbol"), F.col(name).try_cast("int").alias("flag"))
    return universe.select("symbol").join(rows, "symbol", "left").fillna({"flag": 0})


def overrides(spark: SparkSession, fixed: Mapping[str, str | None]) -> DataFrame:
    """(dedup_key, symbol): null leaves a file out."""
    return spark.createDataFrame(list(fixed.items()), "dedup_key string, symbol string")
