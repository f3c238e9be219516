"""Exponentially weighted covariances and the stock covariance, as relations.

A series' weight halves every ``halflife`` rows back from the last date. Only the latest matrix is computed, not one
for each day; ``within`` names columns (a rebalance, say) that each have a matrix of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import constants as C


def _aged(series: DataFrame, halflife: float, within: tuple[str, ...] = ()) -> DataFrame:
    """With the weight w of each date, counted back over the distinct dates of the whole table, and their number."""
    dates = series.select(*within, "date").distinct()
    whole = Window.partitionBy(*within)
    aged = dates.select(*within, "date", (F.row_number().over(whole.orderBy(F.desc("date"))) - 1).alias("age"), F.count("*").over(whole).alias("n_dates"))
    return series.join(F.broadcast(aged.select(*within, "date", F.pow(F.lit(0.5), F.col("age") / halflife).alias("w"), "n_dates")), [*within, "date"])


def ewma_mean(series: DataFrame, by: str = "factor", value: str = "ret", halflife: float = C.EWMA_HALFLIFE, within: tuple[str, ...] = ()) -> DataFrame:
    good = _aged(series, halflife, within).where(F.col(value).isNotNull())
    return good.groupBy(*within, by).agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("mean"))


def _unbiased(rows: DataFrame, by: list[str], x: str, y: str, *more: Column) -> DataFrame:
    """by, n, cov: weighted covariance with the reliability correction, means first and then products."""
    w = Window.partitionBy(*by)
    mean = {"_mx": F.sum(F.col("w") * F.col(x)).over(w) / F.sum("w").over(w), "_my": F.sum(F.col("w") * F.col(y)).over(w) / F.sum("w").over(w)}
    sums = rows.withColumns(mean).groupBy(*by).agg(F.count("*").alias("n"), F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("w")).alias("sww"), F.sum(F.col("w") * (F.col(x) - F.col("_mx")) * (F.col(y) - F.col("_my"))).alias("s"), *more)
    free = F.col("sw") * F.col("sw") - F.col("sww")
    rest = [c for c in sums.columns if c not in (*by, "n", "sw", "sww", "s")]
    return sums.select(*by, "n", *rest, (F.col("s") / F.col("sw") * F.col("sw") * F.col("sw") / F.when(free != 0, free)).alias("cov"))


def ewma_covariance(series: DataFrame, value: str = "ret", halflife: float = C.EWMA_HALFLIFE, least: int | None = None, within: tuple[str, ...] = ()) -> DataFrame:
    """(row, col, cov) of all pairs of factors over the dates on which both have a value; null under ``least`` of them.

    ``least`` is by default twice the half-life, but never more than one less than the number of dates.
    """
    good = _aged(series, halflife, within).where(F.col(value).isNotNull())
    # the factors of a date are a short list (the design columns), so its pairs are made in place, without a self-join
    daily = good.groupBy(*within, "date", "w", "n_dates").agg(F.collect_list(F.struct("factor", F.col(value).alias("x"))).alias("all"))
    pairs = daily.select(*within, "w", "n_dates", "all", F.explode("all").alias("a")).select(*within, "w", "n_dates", F.col("a.factor").alias("row"), F.col("a.x").alias("x"), F.explode("all").alias("b"))
    pairs = pairs.select(*within, "w", "n_dates", "row", F.col("b.factor").alias("col"), "x", F.col("b.x").alias("y")).where("row <= col")
    half = _unbiased(pairs, [*within, "row", "col"], "x", "y", F.first("n_dates").alias("n_dates"))
    enough = F.lit(least) if least is not None else F.greatest(F.lit(1), F.least(F.lit(2 * int(halflife)), F.col("n_dates") - 1))
    half = half.select(*within, "row", "col", F.when(F.col("n") >= enough, F.col("cov")).alias("cov"))
    # both halves of the matrix from one row, not by a second pass
    both = F.when(F.col("row") == F.col("col"), F.array(F.struct("row", "col"))).otherwise(F.array(F.struct("row", "col"), F.struct(F.col("col").alias("row"), F.col("row").alias("col"))))
    return half.select(*within, F.explode(both).alias("at"), "cov").select(*within, "at.row", "at.col", "cov")


def ewma_specific_risk(residuals: DataFrame, value: str = "residual", halflife: float = C.EWMA_HALFLIFE, days: int = C.TRADING_DAYS_PER_YEAR, least: int | None = None) -> DataFrame:
    """(symbol, specific_risk): annualized deviation; a symbol without the last dates is as of its own last value."""
    good = _aged(residuals, halflife).where(F.col(value).isNotNull()).select("symbol", "w", F.col(value).alias("x"))
    var = _unbiased(good, ["symbol"], "x", "x")
    if least is not None:
        var = var.withColumn("cov", F.when(F.col("n") >= least, F.col("cov")))
    return var.select("symbol", F.sqrt(F.col("cov") * days).alias("specific_risk"))


def running_specific_risk(residuals: DataFrame, value: str = "residual", halflife: float = C.EWMA_HALFLIFE, days: int = C.TRADING_DAYS_PER_YEAR) -> DataFrame:
    """(symbol, date, specific_risk) as of each date of each symbol: what :func:`ewma_specific_risk` gives of the rows up to it.

    Sums run along each symbol, so all dates cost one pass and a backtest needs no copy of the history for each rebalance.
    """
    dates = residuals.select("date").distinct().select("date", F.row_number().over(Window.orderBy("date")).alias("i"))
    # weights grow along time instead of halving backward; a common factor leaves the variance as it is
    rows = residuals.where(F.col(value).isNotNull()).join(F.broadcast(dates), "date").select("symbol", "date", F.col(value).alias("x"), F.pow(F.lit(2.0), F.col("i") / halflife).alias("w"))
    so_far = Window.partitionBy("symbol").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    total = {k: F.sum(e).over(so_far) for k, e in {"sw": F.col("w"), "sww": F.col("w") * F.col("w"), "sx": F.col("w") * F.col("x"), "sxx": F.col("w") * F.col("x") * F.col("x")}.items()}
    sums = rows.withColumns(total)
    free = F.col("sw") * F.col("sw") - F.col("sww")
    var = (F.col("sxx") / F.col("sw") - F.pow(F.col("sx") / F.col("sw"), F.lit(2.0))) * F.col("sw") * F.col("sw") / F.when(free > 0, free)
    return sums.select("symbol", "date", F.sqrt(F.greatest(var, F.lit(0.0)) * days).alias("specific_risk"))


def expected_factor_returns(summary: DataFrame, means: DataFrame, t_min: float = C.SHRINK_T_MIN, t_full: float = C.SHRINK_T_FULL, within: tuple[str, ...] = ()) -> DataFrame:
    """(factor, mean, shrinkage, expected): the recent mean times a ramp from 0 at t_min to 1 at t_full of the robust t."""
    ramp = F.least(F.greatest((F.abs("nw_t") - t_min) / (t_full - t_min), F.lit(0.0)), F.lit(1.0))
    both = means.join(summary.select(*within, "factor", "nw_t"), [*within, "factor"])
    return both.withColumn("shrinkage", F.when(F.col("nw_t").isNotNull(), ramp)).withColumn("expected", F.col("mean") * F.col("shrinkage"))


def long_exposures(exposures: DataFrame, factors: list[str]) -> DataFrame:
    """(symbol, factor, x)."""
    return exposures.select("symbol", *[F.col(f).cast("double").alias(f) for f in factors]).unpivot("symbol", factors, "factor", "x")


def projected_returns(exposures: DataFrame, expected: DataFrame) -> DataFrame:
    """(symbol, mu) from long exposures and (factor, expected)."""
    return exposures.join(F.broadcast(expected.select("factor", "expected")), "factor").groupBy("symbol").agg(F.sum(F.col("x") * F.col("expected")).alias("mu"))


def stock_covariance(exposures: DataFrame, factor_cov: DataFrame, specific: DataFrame, days: int = C.TRADING_DAYS_PER_YEAR) -> DataFrame:
    """(row, col, cov) of symbols: X F X' plus the daily specific variances; symbols without specific risk are left out."""
    x = exposures.join(specific.select("symbol"), "symbol", "left_semi")
    xf = x.join(F.broadcast(factor_cov), x["factor"] == factor_cov["row"]).groupBy("symbol", "col").agg(F.sum(F.col("x") * F.col("cov")).alias("v"))
    right = x.select(F.col("symbol").alias("other"), F.col("factor").alias("col"), F.col("x").alias("z"))
    common = xf.join(right, "col").groupBy("symbol", "other").agg(F.sum(F.col("v") * F.col("z")).alias("c"))
    own = specific.select("symbol", (F.col("specific_risk") * F.col("specific_risk") / days).alias("own"))
    out = common.join(own, "symbol")
    return out.select(F.col("symbol").alias("row"), F.col("other").alias("col"), (F.col("c") + F.when(F.col("symbol") == F.col("other"), F.col("own")).otherwise(0.0)).alias("cov"))


def correlations(cov: DataFrame) -> DataFrame:
    """(row, col, corr); undefined ones are zero."""
    var = cov.where("row = col").select("row", F.sqrt("cov").alias("s"))
    both = cov.join(F.broadcast(var), "row").join(F.broadcast(var.select(F.col("row").alias("col"), F.col("s").alias("t"))), "col")
    return both.select("row", "col", F.coalesce(F.col("cov") / F.when(F.col("s") * F.col("t") != 0, F.col("s") * F.col("t")), F.lit(0.0)).alias("corr"))
