"""Winsorizing and z-scores of cross-sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.constants import WINSOR


def winsorize(df: DataFrame, value: str, by: str = "date", bounds: tuple[float, float] = WINSOR, method: str = "percentile", out: str | None = None) -> DataFrame:
    """Clip to the percentiles ``bounds`` (linear between ranks), or to the mean plus bounds times the deviation."""
    w = Window.partitionBy(by)
    if method == "percentile":
        low, high = (F.percentile(value, F.lit(b)).over(w) for b in bounds)
    elif method == "std":
        low, high = (F.avg(value).over(w) + b * F.stddev_samp(value).over(w) for b in bounds)
    else:
        raise ValueError(f"unknown method {method!r}")
    both = df.withColumns({"_low": low, "_high": high})
    # least and greatest skip nulls, so a null value must be kept apart
    clipped = F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), F.col("_low")), F.col("_high")))
    return both.withColumn(out or value, clipped).drop("_low", "_high")


def zscore(df: DataFrame, value: str, by: str = "date", out: str | None = None) -> DataFrame:
    """(x - mean) / deviation; null with fewer than two values or no spread."""
    w = Window.partitionBy(by)
    deviation = F.stddev_samp(value).over(w)
    z = F.when((F.count(value).over(w) >= 2) & (deviation > 0), (F.col(value) - F.avg(value).over(w)) / deviation)
    return df.withColumn(out or value, z)


def winsor_zscore(df: DataFrame, *values: str, by: str = "date", bounds: tuple[float, float] = WINSOR) -> DataFrame:
    """Clip, then standardize, each of ``values`` within ``by``: one shuffle for all columns and both steps."""
    w = Window.partitionBy(by)
    stats = df.withColumns({f"_{v}_{k}": F.percentile(v, F.lit(b)).over(w) for v in values for k, b in zip("lh", bounds, strict=True)})
    clipped = stats.withColumns({v: F.when(F.col(v).isNotNull(), F.least(F.greatest(F.col(v), F.col(f"_{v}_l")), F.col(f"_{v}_h"))) for v in values}).drop(*[f"_{v}_{k}" for v in values for k in "lh"])

    def z(v: str):
        deviation = F.stddev_samp(v).over(w)
        return F.when((F.count(v).over(w) >= 2) & (deviation > 0), (F.col(v) - F.avg(v).over(w)) / deviation)

    return clipped.withColumns({v: z(v) for v in values})
