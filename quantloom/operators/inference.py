"""Inference on series in long form (factor, date, ret): robust means, slopes and multiple tests, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import constants as C


def lag_rule(n: str | Column) -> Column:
    """Lags for n observations: at least one, the whole part of 4 (n / 100)^(2/9)."""
    n = F.col(n) if isinstance(n, str) else n
    return F.greatest(F.lit(1), F.floor(4 * F.pow(n / 100.0, F.lit(2.0 / 9.0)))).cast("int")


def _long_run(series: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """by, n, lags, long_run: n times the Bartlett-weighted long-run variance of ``value`` taken as it is."""
    w = Window.partitionBy(*by)
    numbered = series.where(F.col(value).isNotNull()).select(*by, F.row_number().over(w.orderBy(order)).alias("i"), F.col(value).alias("u"), F.count(value).over(w).alias("n"))
    # pairs up to the lag rule: each row meets the rows before it, by equal (group, position)
    shifted = numbered.withColumn("k", F.explode(F.sequence(F.lit(0), lag_rule("n")))).select(*by, (F.col("i") + F.col("k")).alias("i"), "k", F.col("u").alias("v"))
    pairs = numbered.join(shifted, [*by, "i"])
    weight = F.when(F.col("k") == 0, 1.0).otherwise(2.0 * (1.0 - F.col("k") / (lag_rule("n") + 1.0)))
    return pairs.groupBy(*by).agg(F.first("n").alias("n"), F.sum(weight * F.col("u") * F.col("v")).alias("long_run"))


def newey_west_mean(series: DataFrame, by: list[str], value: str = "ret", order: str = "date") -> DataFrame:
    """by, n, mean, nw_se, nw_t: the mean with heteroskedasticity- and autocorrelation-consistent errors."""
    w = Window.partitionBy(*by)
    centred = series.where(F.col(value).isNotNull()).select(*by, order, (F.col(value) - F.avg(value).over(w)).alias("u"))
    mean = series.where(F.col(value).isNotNull()).groupBy(*by).agg(F.avg(value).alias("mean"))
    out = _long_run(centred, by, "u", order).join(mean, by)
    se = F.sqrt(F.greatest(F.col("long_run"), F.lit(0.0))) / F.col("n")
    return out.select(*by, "n", "mean", se.alias("nw_se")).withColumn("nw_t", F.col("mean") / F.when(F.col("nw_se") > 0, F.col("nw_se")))


def summary(series: DataFrame, by: str | list[str] = "factor", value: str = "ret", least: int = 3) -> DataFrame:
    """For each factor: n, mean, t, robust error and t, share of positive days; short series are left out."""
    by = [by] if isinstance(by, str) else by
    good = series.where(F.col(value).isNotNull())
    plain = good.groupBy(*by).agg((F.avg(value) / F.when(F.stddev_samp(value) > 0, F.stddev_samp(value) / F.sqrt(F.count(value)))).alias("t"), F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("pct_positive"))
    return newey_west_mean(good, by, value).join(plain, by).where(F.col("n") >= least)


def newey_west_slope(rows: DataFrame, by: list[str], x: str, y: str, order: str = "date", least: int = C.MACRO_MIN_MONTHS) -> DataFrame:
    """by, n, slope, intercept, nw_se, nw_t, r2 of y on x and a constant; groups under ``least`` rows are left out."""
    w = Window.partitionBy(*by)
    good = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    slope = F.covar_pop(y, x).over(w) / F.when(F.var_pop(x).over(w) != 0, F.var_pop(x).over(w))
    line = good.withColumns({"_b": slope, "_mx": F.avg(x).over(w), "_my": F.avg(y).over(w)})
    scores = line.select(*by, order, ((F.col(x) - F.col("_mx")) * (F.col(y) - F.col("_my") - F.col("_b") * (F.col(x) - F.col("_mx")))).alias("u"))
    fit = line.groupBy(*by).agg(F.first("_b").alias("slope"), (F.first("_my") - F.first("_b") * F.first("_mx")).alias("intercept"), F.pow(F.corr(x, y), F.lit(2.0)).alias("r2"), (F.var_pop(x) * F.count(x)).alias("sxx"))
    out = _long_run(scores, by, "u", order).join(fit, by).where(F.col("n") >= least)
    return out.withColumn("nw_se", F.sqrt(F.greatest("long_run", F.lit(0.0))) / F.when(F.col("sxx") != 0, F.col("sxx"))).select(*by, "n", "slope", "intercept", "nw_se", (F.col("slope") / F.when(F.col("nw_se") > 0, F.col("nw_se"))).alias("nw_t"), "r2")


def normal_p(t: str | Column) -> Column:
    """Two-sided normal tail in built-in functions (Abramowitz and Stegun 7.1.26, absolute error below 1.5e-7)."""
    x = F.abs(F.col(t) if isinstance(t, str) else t) / (2**0.5)
    k = 1.0 / (1.0 + 0.3275911 * x)
    poly = k * (0.254829592 + k * (-0.284496736 + k * (1.421413741 + k * (-1.453152027 + k * 1.061405429))))
    return poly * F.exp(-x * x)


def monthly_compounded(series: DataFrame, by: str = "factor", value: str = "ret") -> DataFrame:
    """by, month, ret: compounded over the days of a month; a month without values has none."""
    return series.where(F.col(value).isNotNull()).groupBy(by, F.trunc("date", "month").alias("month")).agg((F.product(1 + F.col(value)) - 1).alias("ret"))


def monthly_change(prices: DataFrame, by: str = "name", price: str = "price") -> DataFrame:
    """by, month, change: of the last price of each month; an empty month repeats the last one, so its change is zero."""
    ends = prices.where(F.col(price).isNotNull()).groupBy(by, F.trunc("date", "month").alias("month")).agg(F.max_by(price, "date").alias("price"))
    span = ends.groupBy(by).agg(F.explode(F.sequence(F.min("month"), F.max("month"), F.expr("INTERVAL 1 MONTH"))).alias("month"))
    order = Window.partitionBy(by).orderBy("month")
    filled = span.join(ends, [by, "month"], "left").withColumn("price", F.last("price", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return filled.withColumn("change", F.col("price") / F.lag("price").over(order) - 1).select(by, "month", "change")


def macro_sweep(macro: DataFrame, factors: DataFrame, lag: int = 1, least: int = C.MACRO_MIN_MONTHS, level: float = 0.05) -> DataFrame:
    """Every macro series (name, month, change) against every factor's month ``lag`` later, with Bonferroni's level.

    The number of tests is that of all pairs, also of those too short to test.
    """
    moved = macro.select("name", F.add_months("month", lag).alias("month"), "change")
    pairs = moved.join(factors.select("factor", "month", "ret"), "month")
    n_tests = macro.select("name").distinct().count() * factors.select("factor").distinct().count()
    found = newey_west_slope(pairs, ["name", "factor"], "change", "ret", "month", least).withColumn("p", normal_p("nw_t"))
    return found.withColumns({"significant": F.col("p") < level, "bonferroni": F.col("p") < level / max(1, n_tests)})
