"""Timing signals on a price series (date, price) keyed by ``name``, and the macro tilt of expected returns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import constants as C
from quantloom.operators.inference import monthly_change, monthly_compounded, newey_west_mean, newey_west_slope


def signed(x: Column) -> Column:
    """Sign with zero counted as up; a null stays null."""
    return F.when(x.isNotNull(), F.when(x >= 0, 1.0).otherwise(-1.0))


def price_index(returns: DataFrame, by: str = "name") -> DataFrame:
    w = Window.partitionBy(by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("price", F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w))


def _ema(values: Column, span: int) -> Column:
    """Recursive average of an ordered array: the first value, then alpha of the new and the rest of the old."""
    alpha = 2.0 / (span + 1)
    start = F.struct(F.lit(None).cast("double").alias("last"), F.array().cast("array<double>").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        new = F.when(acc["last"].isNull(), x).otherwise(alpha * x + (1 - alpha) * acc["last"])
        return F.struct(new.alias("last"), F.concat(acc["all"], F.array(new)).alias("all"))

    return F.aggregate(values, start, step, lambda acc: acc["all"])


def macd(prices: DataFrame, by: str = "name", fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """Difference of two recursive averages against its own average. A series is one row, walked in order of dates."""
    series = prices.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("date", "price"))).alias("s"))
    series = series.select(by, F.transform("s", lambda x: x["date"]).alias("dates"), F.transform("s", lambda x: x["price"]).alias("p"))
    both = series.withColumns({"a": _ema(F.col("p"), fast), "b": _ema(F.col("p"), slow)})
    line = both.withColumn("m", F.zip_with("a", "b", lambda x, y: x - y)).withColumn("g", _ema(F.col("m"), signal))
    out = line.select(by, F.explode(F.arrays_zip("dates", "m", "g")).alias("z")).select(by, F.col("z.dates").alias("date"), F.col("z.m").alias("macd"), F.col("z.g").alias("signal"))
    return out.withColumn("position", signed(F.col("macd") - F.col("signal")))


def sma_cross(prices: DataFrame, by: str = "name", n: int = 30) -> DataFrame:
    w = Window.partitionBy(by).orderBy("date").rowsBetween(-(n - 1), 0)
    mean = F.when(F.count("price").over(w) >= n, F.avg("price").over(w))
    return prices.withColumn("sma", mean).withColumn("position", signed(F.col("price") - F.col("sma")))


def series_momentum(prices: DataFrame, by: str = "name", lookback: int = C.MOMENTUM_LOOKBACK_DAYS, skip: int = C.MOMENTUM_LAG_DAYS) -> DataFrame:
    w = Window.partitionBy(by).orderBy("date")
    past = F.lag("price", skip + lookback).over(w)
    return prices.withColumn("trailing", F.lag("price", skip).over(w) / F.when(past != 0, past) - 1).withColumn("position", signed(F.col("trailing")))


def timing_alpha(positions: DataFrame, returns: DataFrame, by: str = "name", days: int = C.TRADING_DAYS_PER_YEAR) -> DataFrame:
    """Does yesterday's position times today's return beat holding? Means, volatilities, and the robust t of the excess."""
    order = Window.partitionBy(by).orderBy("date")
    both = returns.join(positions.select(by, "date", "position"), [by, "date"], "left").withColumn("pos", F.lag("position").over(order)).where("pos IS NOT NULL AND ret IS NOT NULL")
    both = both.withColumn("timed", F.col("pos") * F.col("ret")).withColumn("excess", F.col("timed") - F.col("ret"))
    root = float(days) ** 0.5
    stats = both.groupBy(by).agg(*[x for c, k in (("ret", "hold"), ("timed", "timed")) for x in ((F.avg(c) * days).alias(f"{k}_return"), (F.stddev_samp(c) * root).alias(f"{k}_vol"))], F.avg(F.when(F.col("pos") > 0, 1.0).otherwise(0.0)).alias("pct_long"))
    return stats.join(newey_west_mean(both, [by], "excess").select(by, "n", F.col("mean").alias("excess_mean"), F.col("nw_se").alias("excess_se"), F.col("nw_t").alias("excess_t")), by)


def group_spread(returns: DataFrame, members: DataFrame) -> DataFrame:
    """(date, ret): mean return of the members less the mean of the rest."""
    marked = returns.join(F.broadcast(members.select("symbol", F.lit(True).alias("_in")).distinct()), "symbol", "left")
    inside = F.col("_in").isNotNull()
    return marked.groupBy("date").agg((F.avg(F.when(inside, F.col("ret"))) - F.avg(F.when(~inside, F.col("ret")))).alias("ret"))


def macro_momentum(prices: DataFrame, months: int = C.MACRO_MOMENTUM_MONTHS, by: str = "name") -> DataFrame:
    """(name, month, momentum): change compounded over the last months."""
    w = Window.partitionBy(by).orderBy("month").rowsBetween(-(months - 1), 0)
    change = monthly_change(prices, by)
    return change.withColumn("momentum", F.when(F.count("change").over(w) >= months, F.product(1 + F.col("change")).over(w) - 1)).select(by, "month", "momentum")


def group_spreads(returns: DataFrame, members: DataFrame) -> DataFrame:
    """(factor, date, ret) for each group of ``members`` (name, symbol): its mean return less that of all others.

    The others' sum is the date's total less the group's, so returns meet their own groups only.
    """
    good = returns.where("ret IS NOT NULL").select("date", "symbol", "ret")
    total = good.groupBy("date").agg(F.sum("ret").alias("s"), F.count("*").alias("n"))
    inside = good.join(F.broadcast(members.select("name", "symbol").distinct()), "symbol").groupBy(F.col("name").alias("factor"), "date").agg(F.sum("ret").alias("gs"), F.count("*").alias("gn"))
    rest = F.col("n") - F.col("gn")
    return inside.join(total, "date").select("factor", "date", (F.col("gs") / F.col("gn") - (F.col("s") - F.col("gs")) / F.when(rest > 0, rest)).alias("ret"))


def macro_tilts(returns: DataFrame, groups: DataFrame, prices: DataFrame, rebalances: DataFrame, months: int = C.MACRO_MOMENTUM_MONTHS, least: int = C.MACRO_MIN_MONTHS, days: int = C.TRADING_DAYS_PER_MONTH) -> DataFrame:
    """(as_of, symbol, tilt) of the members of groups: the daily tilt of expected returns as of each of ``rebalances``.

    Groups are (name, symbol), prices (name, date, price). A group's monthly spread is regressed on last month's momentum
    of its price; the slope times the latest momentum, by day, is added for its members. Groups of fewer than two symbols
    or with short histories add nothing. Only groups' spreads and prices, a few series, are dealt to the rebalances.
    """
    there = groups.join(returns.select("symbol").distinct(), "symbol", "left_semi")
    big = there.groupBy("name").agg(F.countDistinct("symbol").alias("n")).where("n >= 2").select("name")
    there = there.join(F.broadcast(big), "name", "left_semi")
    dates = F.broadcast(rebalances.select("as_of"))

    def seen(df: DataFrame, name: str) -> DataFrame:
        """Series by (as_of, name), named ``key``, up to the date."""
        dealt = df.join(dates, F.col("date") <= F.col("as_of"))
        return dealt.withColumn("key", F.concat_ws("@", F.col("as_of").cast("string"), name))

    monthly = monthly_compounded(seen(group_spreads(returns, there), "factor"), "key")
    priced = seen(prices.join(F.broadcast(big), "name", "left_semi"), "name")
    momentum = macro_momentum(priced.drop("name"), months, "key")
    lagged = momentum.select("key", F.add_months("month", 1).alias("month"), "momentum")
    fit = newey_west_slope(monthly.join(lagged, ["key", "month"]), ["key"], "momentum", "ret", "month", least)
    last = momentum.where("momentum IS NOT NULL").groupBy("key").agg(F.max_by("momentum", "month").alias("now"))
    named = fit.join(last, "key").select(F.expr("substring(key, 1, instr(key, '@') - 1)").cast("date").alias("as_of"), F.expr("substring(key, instr(key, '@') + 1)").alias("name"), (F.col("slope") * F.col("now") / days).alias("tilt"))
    return there.join(F.broadcast(named), "name").groupBy("as_of", "symbol").agg(F.sum("tilt").alias("tilt"))


def macro_tilt(returns: DataFrame, groups: DataFrame, prices: DataFrame, months: int = C.MACRO_MOMENTUM_MONTHS, least: int = C.MACRO_MIN_MONTHS, days: int = C.TRADING_DAYS_PER_MONTH, as_of: str | None = None) -> DataFrame:
    """(symbol, tilt) of all symbols as of one date (by default the last of either table): see :func:`macro_tilts`."""
    if as_of:
        when = returns.sparkSession.range(1).select(F.lit(as_of).cast("date").alias("as_of"))
    else:
        when = returns.select("date").union(prices.select("date")).agg(F.max("date").alias("as_of"))
    universe = returns.join(F.broadcast(when), F.col("date") <= F.col("as_of")).select("symbol").distinct()
    return universe.join(macro_tilts(returns, groups, prices, when, months, least, days).select("symbol", "tilt"), "symbol", "left").fillna({"tilt": 0.0})
