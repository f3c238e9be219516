"""Factor exposures of a panel (date, symbol, ...). Each function adds columns; none shuffles by more than one key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import constants as C
from quantloom.operators.panel import by_symbol, forward_filled, last_rows, rolling


def rolling_beta(panel: DataFrame, ret: str = "ret", market: str = "market_ret", n: int = C.BETA_LOOKBACK_DAYS) -> DataFrame:
    """beta and idio_vol over the last n rows: covariance over variance of the market, and the rest of the variance."""
    w = last_rows(n)
    both = F.col(ret).isNotNull() & F.col(market).isNotNull()
    r, m = F.when(both, F.col(ret)), F.when(both, F.col(market))
    full = (F.count(r).over(w) >= n) & (F.count(F.col(market)).over(w) >= n)
    var_m = F.var_samp(market).over(w)
    beta = F.covar_samp(r, m).over(w) / F.when(var_m != 0, var_m)
    out = panel.withColumn("beta", F.when(full, beta))
    rest = F.var_samp(ret).over(w) - F.col("beta") * F.col("beta") * F.var_samp(market).over(w)
    return out.withColumn("idio_vol", F.when(F.col("beta").isNotNull(), F.sqrt(F.greatest(rest, F.lit(0.0)))))


def momentum(panel: DataFrame, price: str = "price", lookback: int = C.MOMENTUM_LOOKBACK_DAYS, skip: int = C.MOMENTUM_LAG_DAYS) -> DataFrame:
    past = F.lag(price, lookback).over(by_symbol())
    return panel.withColumn("momentum", F.lag(price, skip).over(by_symbol()) / F.when(past != 0, past) - 1)


def reversal(panel: DataFrame, price: str = "price", lookback: int = C.MOMENTUM_LAG_DAYS) -> DataFrame:
    past = F.lag(price, lookback).over(by_symbol())
    return panel.withColumn("reversal", -(F.col(price) / F.when(past != 0, past) - 1))


def holiday_filled(grid: DataFrame, volume: str = "volume", share: float = C.HOLIDAY_SHARE, out: str = "volume_filled") -> DataFrame:
    """Dates on which at least ``share`` of the symbols have no volume are nulled, then all gaps are filled forward."""
    idle = F.avg(F.when(F.col(volume).isNull() | (F.col(volume) == 0), 1.0).otherwise(0.0)).over(Window.partitionBy("date"))
    kept = grid.withColumn("holiday", idle >= share).withColumn(out, F.when(~F.col("holiday"), F.col(volume)))
    return kept.withColumn(out, forward_filled(out))


def liquidity(panel: DataFrame, volume: str = "volume_filled", shares: str = "shares", n: int = C.LIQUIDITY_LOOKBACK_DAYS) -> DataFrame:
    """Log of the mean turnover of n full rows."""
    turnover = F.col(volume) / F.when(F.col(shares) != 0, F.col(shares))
    with_turnover = panel.withColumn("_turnover", turnover)
    mean = rolling(F.avg("_turnover"), "_turnover", n)
    return with_turnover.withColumn("_mean", mean).withColumn("liquidity", F.when(F.col("_mean") > 0, F.ln("_mean"))).drop("_turnover", "_mean")


def log_size(value: str | Column = "market_cap") -> Column:
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v > 0, F.ln(v))


def size_decile(panel: DataFrame, value: str = "size", buckets: int = 10) -> DataFrame:
    """Quantile label 1..10 of the rank within a date (equal values by symbol); null with fewer than ten values.

    Cuts lie at even quantiles of the ranks 1..n: label k holds ranks up to 1 + k (n - 1) / 10.
    """
    valid = F.col(value).isNotNull()
    rank = F.row_number().over(Window.partitionBy("date", valid).orderBy(value, "symbol"))
    n = F.count(value).over(Window.partitionBy("date"))
    ranked = panel.withColumns({"_rank": rank, "_n": n})
    label = F.greatest(F.lit(1), F.ceil(F.lit(buckets) * (F.col("_rank") - 1) / (F.col("_n") - 1))).cast("int")
    return ranked.withColumn("size_decile", F.when(valid & (F.col("_n") >= buckets), label)).drop("_rank", "_n")


def decile_dummies(panel: DataFrame, label: str = "size_decile", buckets: int = 10) -> DataFrame:
    """0/1 columns for labels 2 and up; a null label gives nulls."""
    return panel.withColumns({f"{label}_{k}": F.when(F.col(label).isNotNull(), (F.col(label) == k).cast("int")) for k in range(2, buckets + 1)})


def top_flag(panel: DataFrame, value: str = "market_cap", n: int = C.TOP_N, out: str = "top100_flag") -> DataFrame:
    """1 for the n largest of a date (equal values by symbol), else 0; null or non-positive values have no flag."""
    valid = F.col(value) > 0
    rank = F.row_number().over(Window.partitionBy("date", F.coalesce(valid, F.lit(False))).orderBy(F.desc(value), "symbol"))
    return panel.withColumn("_rank", rank).withColumn(out, F.when(valid, (F.col("_rank") <= n).cast("double"))).drop("_rank")


def decile_means(panel: DataFrame, value: str = "ret", label: str = "size_decile") -> DataFrame:
    """(label, mean): mean value of each decile over all dates."""
    return panel.where(F.col(label).isNotNull() & F.col(value).isNotNull()).groupBy(label).agg(F.avg(value).alias("mean"))


def static_attributes(grid: DataFrame, attributes: DataFrame, fill: dict[str, float] | None = None) -> DataFrame:
    """Attributes of symbols on every date; symbols without them get ``fill``."""
    out = grid.join(attributes, "symbol", "left")
    return out.fillna(fill) if fill else out


def mean_of_valid(columns: list[str], least: int) -> Column:
    """Mean of the columns that are not null, if there are at least ``least``."""
    values = [F.col(c) for c in columns]
    n = reduce(lambda a, b: a + b, [v.isNotNull().cast("int") for v in values])
    total = reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values])
    return F.when(n >= least, total / n)


def value_composite(panel: DataFrame, price: str = "price") -> DataFrame:
    """Mean of the standardized earnings, book and dividend yields, of at least two."""
    from quantloom.operators.standardize import winsor_zscore

    positive = F.col(price) > 0
    raw = panel.withColumns({"_ep": F.when(positive & (F.col("eps") > 0), F.col("eps") / F.col(price)), "_bp": F.when(positive & (F.col("bvps") > 0), F.col("bvps") / F.col(price)), "_dy": F.when(positive & (F.col("dps") >= 0), F.col("dps") / F.col(price))})
    return winsor_zscore(raw, "_ep", "_bp", "_dy").withColumn("value", mean_of_valid(["_ep", "_bp", "_dy"], 2)).drop("_ep", "_bp", "_dy")


def quality_composite(panel: DataFrame) -> DataFrame:
    """Mean of the standardized returns on assets and on equity, of at least one."""
    from quantloom.operators.standardize import winsor_zscore

    raw = panel.withColumns({"_roa": F.col("roa"), "_roe": F.col("roe")})
    return winsor_zscore(raw, "_roa", "_roe").withColumn("quality", mean_of_valid(["_roa", "_roe"], 1)).drop("_roa", "_roe")


def seasonal_surprise(quarterly: DataFrame, profit: str = "net_profit", lag: int = 4, n: int = 8, least: int = 3, announce_days: int = C.QUARTERLY_REPORTING_LAG_DAYS) -> DataFrame:
    """Standardized surprise: the change on the same quarter of last year over the deviation of the last n such changes."""
    order = Window.partitionBy("symbol").orderBy("quarter_end")
    change = quarterly.withColumn("change", F.col(profit) - F.lag(profit, lag).over(order))
    w = order.rowsBetween(-(n - 1), 0)
    deviation = F.when(F.count("change").over(w) >= least, F.stddev_samp("change").over(w))
    out = change.withColumn("_dev", deviation).withColumn("sue", F.when(F.col("_dev") > 0, F.col("change") / F.col("_dev")))
    return out.withColumn("announced", F.date_add("quarter_end", announce_days)).drop("_dev")
