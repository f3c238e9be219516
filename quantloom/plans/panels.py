"""Queries on panels: returns, reshapes, filters, set operations, top-k, standardization."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.operators import panel as P
from quantloom.operators import standardize as S
from quantloom.plans import base as B
from quantloom.plans.base import query, r6, rounded, zsql


#: Prices are cents over whole quantities, so they can lie half way between two roundings; this tips them one way.
NUDGE = 2e-10


def nudged(df: DataFrame, column: str = "price") -> DataFrame:
    return df.withColumn(column, F.col(column) + NUDGE)


@query("SELECT date, symbol, round(price + 2e-10, 6) + 0.0 AS price, round(ret, 6) + 0.0 AS ret FROM drets")
def panel_returns_pad(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(nudged(B.panel(spark, sf, "day").select("date", "symbol", "price", "ret")), "price", "ret")


@query("SELECT date, symbol, round(price / nullif(lag(price) OVER (PARTITION BY symbol ORDER BY date), 0) - 1, 6) + 0.0 AS ret FROM dgrid")
def panel_returns_unfilled(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.with_returns(P.full_grid(B.prices(spark, sf, "day")), fill=False).select("date", "symbol", "ret"), "ret")


@query("SELECT date, round(price + 2e-10, 6) + 0.0 AS price, round(market_ret, 6) + 0.0 AS market_ret FROM mkt")
def benchmark_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(nudged(B.market(spark, sf)), "price", "market_ret")


@query("SELECT date, symbol, price IS NOT NULL AS present FROM dgrid")
def grid_full(spark: SparkSession, sf: str) -> DataFrame:
    return P.full_grid(B.prices(spark, sf, "day")).select("date", "symbol", F.col("price").isNotNull().alias("present"))


@query("SELECT l_orderkey, l_linenumber, measure, round(value, 6) + 0.0 AS value FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT (value FOR measure IN (l_quantity, l_discount, l_tax))")
def melt_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    line = B.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    return rounded(line.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount", "l_tax"], "measure", "value"), "value")


BRANDS = [f"Brand#{k}" for k in range(1, 26)]  # all there are


@query("SELECT date, " + ", ".join(f"round(max(CASE WHEN symbol = '{b}' THEN price END) + 2e-10, 6) + 0.0 AS b{b[6:]}" for b in BRANDS) + " FROM px GROUP BY date")
def pivot_wide(spark: SparkSession, sf: str) -> DataFrame:
    wide = P.pivot(B.prices(spark, sf), "price", BRANDS)
    return wide.select("date", *[r6(F.col(f"`{n}`") + NUDGE).alias(f"b{n[6:]}") for n in BRANDS])


@query("SELECT date, symbol, round(price + 2e-10, 6) + 0.0 AS value FROM px")
def melt_wide(spark: SparkSession, sf: str) -> DataFrame:
    wide = P.pivot(B.prices(spark, sf), "price", BRANDS)
    return rounded(nudged(P.melt(wide).where("value IS NOT NULL"), "value"), "value")


@query("SELECT date, symbol, round(v, 6) + 0.0 AS ret FROM (SELECT *, CASE WHEN ret IS NOT NULL THEN least(greatest(ret, quantile_cont(ret, 0.05) OVER w), quantile_cont(ret, 0.95) OVER w) END AS v FROM rets WINDOW w AS (PARTITION BY date))")
def winsor_pct(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.winsorize(B.panel(spark, sf), "ret", bounds=(0.05, 0.95)).select("date", "symbol", "ret"), "ret")


@query("SELECT date, symbol, round(v, 6) + 0.0 AS ret FROM (SELECT *, CASE WHEN ret IS NOT NULL THEN least(greatest(ret, avg(ret) OVER w - 1.5 * stddev_samp(ret) OVER w), avg(ret) OVER w + 1.5 * stddev_samp(ret) OVER w) END AS v FROM rets WINDOW w AS (PARTITION BY date))")
def winsor_std(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.winsorize(B.panel(spark, sf), "ret", bounds=(-1.5, 1.5), method="std").select("date", "symbol", "ret"), "ret")


@query("SELECT date, symbol, round(CASE WHEN count(ret) OVER w >= 2 AND stddev_samp(ret) OVER w > 0 THEN (ret - avg(ret) OVER w) / stddev_samp(ret) OVER w END, 6) + 0.0 AS z FROM rets WINDOW w AS (PARTITION BY date)")
def zscore(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(S.zscore(B.panel(spark, sf), "ret", out="z").select("date", "symbol", "z"), "z")


@query(f"SELECT date, symbol, round(z, 6) + 0.0 AS z FROM {zsql('ret', 'rets')}")
def winsor_zscore(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: monthly brand returns, winsorized and standardized within each month."""
    return B.panel(spark, sf).select("date", "symbol", "ret").transform(lambda d: S.winsor_zscore(d, "ret")).select("date", "symbol", r6("ret").alias("z"))


PERIODS = {"early": ("1995-01-01", "1998-01-01"), "middle": ("1998-01-01", "2000-01-01"), "late": ("2000-01-01", "2100-01-01")}


@query("SELECT p.period, symbol, count(ret) AS n, round(avg(ret), 6) + 0.0 AS mean_ret FROM rets JOIN (VALUES " + ", ".join(f"('{k}', DATE '{a}', DATE '{b}')" for k, (a, b) in PERIODS.items()) + ") p(period, a, b) ON date >= a AND date < b GROUP BY ALL")
def period_slices(spark: SparkSession, sf: str) -> DataFrame:
    return P.periods(B.panel(spark, sf), PERIODS).groupBy("period", "symbol").agg(F.count("ret").alias("n"), r6(F.avg("ret")).alias("mean_ret"))


@query("SELECT date, symbol, round(price + 2e-10, 6) + 0.0 AS price FROM grid WHERE date <= DATE '1997-06-30' AND date >= DATE '1997-01-01'")
def as_of_slice(spark: SparkSession, sf: str) -> DataFrame:
    cut = P.date_range(P.as_of(P.full_grid(B.prices(spark, sf)), "1997-06-30"), start="1997-01-01")
    return rounded(nudged(cut.select("date", "symbol", "price")), "price")


@query("SELECT date, symbol, round(ret, 6) + 0.0 AS ret FROM rets WHERE date = (SELECT max(date) FROM rets) AND ret IS NOT NULL AND volume IS NOT NULL")
def latest_complete(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.latest(B.panel(spark, sf), ["ret", "volume"]).select("date", "symbol", "ret"), "ret")


@query("SELECT symbol, count(ret) AS n, round(avg(ret), 6) + 0.0 AS mean_ret FROM rets WHERE date IN (SELECT DISTINCT date FROM rets ORDER BY date DESC LIMIT 12) GROUP BY symbol")
def trailing_mean(spark: SparkSession, sf: str) -> DataFrame:
    return P.last_dates(B.panel(spark, sf), 12).groupBy("symbol").agg(F.count("ret").alias("n"), r6(F.avg("ret")).alias("mean_ret"))


@query("SELECT date, count(*) AS n FROM rets WHERE date IN (SELECT date FROM (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, greatest(1, count(*) OVER () // 20) AS stride FROM (SELECT DISTINCT date FROM rets)) WHERE i % stride = 0 AND i // stride < 20) GROUP BY date")
def sampled_dates(spark: SparkSession, sf: str) -> DataFrame:
    return P.every_kth_date(B.panel(spark, sf), 20).groupBy("date").agg(F.count("*").alias("n"))


@query("SELECT max(date) AS date FROM (SELECT DISTINCT date FROM dpx) WHERE date >= DATE '1996-03-01' GROUP BY date_trunc('month', date)")
def month_end_dates(spark: SparkSession, sf: str) -> DataFrame:
    return P.month_end_dates(P.calendar(B.prices(spark, sf, "day")), "1996-03-15")


@query("SELECT date, lead(date) OVER (ORDER BY date) AS target_date FROM (SELECT DISTINCT date FROM px) QUALIFY target_date IS NOT NULL")
def next_date_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return P.next_date(P.calendar(B.prices(spark, sf)))


@query("SELECT o_custkey AS custkey, o_orderkey AS orderkey, o_orderdate::DATE AS date FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def dedupe_newest(spark: SparkSession, sf: str) -> DataFrame:
    orders = B.table(spark, sf, "orders")
    newest = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return orders.withColumn("_r", newest).where("_r = 1").select(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("orderkey"), F.to_date("o_orderdate").alias("date"))


@query("""SELECT date, symbol, round(price + 2e-10, 6) + 0.0 AS price FROM (
    SELECT date, symbol, price FROM px WHERE date < DATE '1998-01-01' AND date NOT IN (SELECT date FROM px WHERE date >= DATE '1997-06-01')
    UNION ALL SELECT date, symbol, 2 * price FROM px WHERE date >= DATE '1997-06-01')""")
def upsert_refresh(spark: SparkSession, sf: str) -> DataFrame:
    """A price refresh: new rows replace old rows of the same date and symbol."""
    px = B.prices(spark, sf).select("date", "symbol", "price")
    new = P.date_range(px, start="1997-06-01").withColumn("price", 2 * F.col("price"))
    return rounded(nudged(P.upsert(P.date_range(px, end="1998-01-01"), new, ["date", "symbol"])), "price")


_BIG, _MANY = "SELECT DISTINCT symbol FROM dpx WHERE price > 1100", "SELECT symbol FROM lines GROUP BY symbol HAVING sum(qty) > (SELECT avg(q) FROM (SELECT sum(qty) AS q FROM lines GROUP BY symbol))"


@query(f"SELECT 'both' AS op, symbol FROM (({_BIG}) INTERSECT ({_MANY})) UNION ALL SELECT 'only_first', symbol FROM (({_BIG}) EXCEPT ({_MANY})) UNION ALL SELECT 'either', symbol FROM (({_BIG}) UNION ({_MANY}))")
def symbol_set_ops(spark: SparkSession, sf: str) -> DataFrame:
    first = B.prices(spark, sf, "day").where("price > 1100").select("symbol").distinct()
    total = B.lines(spark, sf).groupBy("symbol").agg(F.sum("qty").alias("q"))
    second = total.join(F.broadcast(total.agg(F.avg("q").alias("m"))), F.col("q") > F.col("m")).select("symbol")
    tag = lambda df, op: df.select(F.lit(op).alias("op"), "symbol")
    return tag(first.intersect(second), "both").unionByName(tag(first.join(second, "symbol", "left_anti"), "only_first")).unionByName(tag(first.union(second).distinct(), "either"))


@query("SELECT symbol, CAST(rank AS INTEGER) AS rank, date, round(ret, 6) + 0.0 AS ret FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ret DESC, date) AS rank FROM rets WHERE ret IS NOT NULL) WHERE rank <= 3")
def top_k_returns(spark: SparkSession, sf: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ret"), "date"))
    return rounded(B.panel(spark, sf).where("ret IS NOT NULL").withColumn("rank", rank).where("rank <= 3").select("symbol", "rank", "date", "ret"), "ret")


@query("SELECT g.date, g.symbol, round(coalesce(x.price, 0) + 2e-10, 6) + 0.0 AS price FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM orders) d CROSS JOIN (SELECT DISTINCT symbol FROM px) s JOIN LATERAL (SELECT d.date, s.symbol) g ON TRUE LEFT JOIN px x ON x.date = g.date AND x.symbol = g.symbol")
def reindexed_to_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Prices on another table's calendar; what is missing is filled."""
    px = B.prices(spark, sf)
    months = B.table(spark, sf, "orders").select(F.trunc(F.to_date("o_orderdate"), "month").alias("date")).distinct()
    keys = px.select("symbol").distinct().crossJoin(F.broadcast(months))
    return rounded(nudged(P.reindexed(px, keys, ["date", "symbol"], {"price": 0.0}).select("date", "symbol", "price")), "price")


@query("SELECT count(DISTINCT date) AS n_dates, count(DISTINCT symbol) AS n_symbols, count(*) AS n_rows FROM dgrid")
def panel_counts(spark: SparkSession, sf: str) -> DataFrame:
    return P.full_grid(B.prices(spark, sf, "day")).agg(F.countDistinct("date").alias("n_dates"), F.countDistinct("symbol").alias("n_symbols"), F.count("*").alias("n_rows"))
