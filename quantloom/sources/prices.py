"""Wide price and volume files as long panels, and the views the model is built on."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators.panel import melt, missing_as_null, upsert, with_returns


def _read(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PARQUET_TYPE_ILLEGAL":
            raise
    # timestamps in nanoseconds have no type in Spark; they are read as numbers
    spark.conf.set("spark.sql.legacy.parquet.nanosAsLong", "true")
    return spark.read.parquet(path)


def load_wide(spark: SparkSession, path: str, universe: Iterable[str] | None = None, date: str = "Date") -> tuple[DataFrame, list[str]]:
    """A file of one column a symbol as (date, symbol, value), and the symbols of the universe that it lacks.

    Only the wanted columns are read. Dates may be dates, timestamps or, as some writers store them, nanoseconds.
    """
    raw = _read(spark, path)
    there = [c for c in raw.columns if c != date]
    wanted = [s for s in (universe if universe is not None else there) if s in set(there)]
    missing = [s for s in (universe or []) if s not in set(there)]
    columns = [F.col(f"`{c}`").cast("double").alias(c) for c in wanted]
    day = F.col(f"`{date}`")
    day = F.timestamp_micros((day / 1000).cast("long")) if raw.schema[date].dataType.simpleString() == "bigint" else day
    wide = raw.select(F.to_date(day).alias("date"), *columns)
    return missing_as_null(melt(wide), "value"), missing


def load_prices(spark: SparkSession, path: str, universe: Iterable[str] | None = None) -> DataFrame:
    return load_wide(spark, path, universe)[0].withColumnRenamed("value", "price")


def load_benchmark(spark: SparkSession, path: str, name: str) -> DataFrame:
    return load_wide(spark, path, [name])[0].select("date", F.col("value").alias("price"))


def load_volume(spark: SparkSession, path: str, universe: Iterable[str] | None = None) -> DataFrame:
    return load_wide(spark, path, universe)[0].withColumnRenamed("value", "volume")


def returns_view(prices: DataFrame, benchmark: str, fill: bool = True) -> DataFrame:
    """Daily changes of all symbols but the benchmark."""
    return with_returns(prices.where(F.col("symbol") != benchmark), fill=fill)


def benchmark_returns_view(prices: DataFrame, benchmark: str, fill: bool = True) -> DataFrame:
    return with_returns(prices.where(F.col("symbol") == benchmark), fill=fill, out="market_ret").select("date", "price", "market_ret")


def refreshed(old: DataFrame, fetched: DataFrame) -> DataFrame:
    """Prices after a refresh: fetched rows replace old ones of the same date and symbol. Fetching is the caller's."""
    return upsert(old, fetched.select(*old.columns), ["date", "symbol"])
