"""Queries of factor exposures: time-series windows, statements seen point in time, composites, labels, the panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import asof as A
from quantloom.operators import factors as X
from quantloom.operators import fundamentals as R
from quantloom.operators import panel as P
from quantloom.operators import standardize as S
from quantloom.plans import base as B
from quantloom.plans.base import CTE, query, r6, rounded, shared, zsql

N = 12  # months of a lookback here


def with_market(spark: SparkSession, sf: str) -> DataFrame:
    return B.panel(spark, sf).join(F.broadcast(B.market(spark, sf).select("date", "market_ret")), "date")


_BETA = f"""SELECT *, CASE WHEN count(ret) OVER w >= {N} AND count(market_ret) OVER w >= {N} THEN covar_samp(ret, market_ret) OVER w / nullif(var_samp(market_ret) OVER w, 0) END AS beta,
    var_samp(ret) OVER w AS vr, var_samp(market_ret) OVER w AS vm FROM (SELECT rets.*, market_ret FROM rets JOIN mkt USING (date))
    WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW)"""


@query(f"SELECT date, symbol, round(beta, 6) + 0.0 AS beta FROM ({_BETA})")
def rolling_beta(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.rolling_beta(with_market(spark, sf), n=N).select("date", "symbol", "beta"), "beta")


@query(f"SELECT date, symbol, round(CASE WHEN beta IS NOT NULL THEN sqrt(greatest(vr - beta * beta * vm, 0)) END, 6) + 0.0 AS idio_vol FROM ({_BETA})")
def idio_vol(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.rolling_beta(with_market(spark, sf), n=N).select("date", "symbol", "idio_vol"), "idio_vol")


@query(f"SELECT date, symbol, round(lag(price, 1) OVER w / nullif(lag(price, {N}) OVER w, 0) - 1, 6) + 0.0 AS momentum FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY date)")
def momentum(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.momentum(B.panel(spark, sf), lookback=N, skip=1).select("date", "symbol", "momentum"), "momentum")


@query("SELECT date, symbol, round(-(price / nullif(lag(price, 1) OVER (PARTITION BY symbol ORDER BY date), 0) - 1), 6) + 0.0 AS reversal FROM grid")
def reversal(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.reversal(B.panel(spark, sf), lookback=1).select("date", "symbol", "reversal"), "reversal")


_HOLIDAY = "SELECT *, avg(CASE WHEN volume IS NULL OR volume = 0 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY date) AS idle FROM dgrid"


@query(f"SELECT date, symbol, idle >= 0.5 AS holiday, round(last_value(CASE WHEN idle < 0.5 THEN volume END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) + 0.0 AS volume_filled FROM ({_HOLIDAY})")
def holiday_ffill(spark: SparkSession, sf: str) -> DataFrame:
    filled = X.holiday_filled(P.full_grid(B.prices(spark, sf, "day")))
    return rounded(filled.select("date", "symbol", "holiday", "volume_filled"), "volume_filled")


def point_in_time(spark: SparkSession, sf: str, values: list[str] | None = None) -> DataFrame:
    """The monthly grid with the ratios that are visible by then."""
    events = A.visible_from(R.annual_ratios(B.annual(spark, sf)))
    return A.as_of_join(B.panel(spark, sf), events, values or ["shares", "leverage", "roa", "roe", "net_margin", "eps", "bvps", "dps", "accruals", "capex", "revenue_growth"])


@query(f"SELECT date, symbol, round(CASE WHEN n >= {N} AND m > 0 THEN ln(m) END, 6) + 0.0 AS liquidity FROM (SELECT *, count(t) OVER w AS n, avg(t) OVER w AS m FROM (SELECT date, symbol, volume / nullif(shares, 0) AS t FROM pit) WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW))")
def liquidity(spark: SparkSession, sf: str) -> DataFrame:
    rows = point_in_time(spark, sf, ["shares"])
    return rounded(X.liquidity(rows, volume="volume", n=N).select("date", "symbol", "liquidity"), "liquidity")


@query("SELECT symbol, fiscal_year_end, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in ("leverage", "roa", "roe", "net_margin", "eps", "bvps", "dps", "capex", "revenue_growth", "accruals")) + " FROM ratios")
def annual_ratios(spark: SparkSession, sf: str) -> DataFrame:
    c = ["leverage", "roa", "roe", "net_margin", "eps", "bvps", "dps", "capex", "revenue_growth", "accruals"]
    return rounded(R.annual_ratios(B.annual(spark, sf)).select("symbol", "fiscal_year_end", *c), *c)


@query("""SELECT symbol, fiscal_year_end, round(CASE WHEN gap < 300 OR gap > 430 THEN NULL ELSE revenue_growth END, 6) + 0.0 AS revenue_growth FROM (
    SELECT symbol, fiscal_year_end, sales / nullif(lag(sales) OVER w, 0) - 1 AS revenue_growth, date_diff('day', lag(fiscal_year_end) OVER w, fiscal_year_end) AS gap
    FROM statements WHERE year(fiscal_year_end) <> 1997 WINDOW w AS (PARTITION BY symbol ORDER BY fiscal_year_end))""")
def non_annual_gap_null(spark: SparkSession, sf: str) -> DataFrame:
    """With a year missing, growth across the gap is not reported."""
    rows = B.annual(spark, sf).where("year(fiscal_year_end) <> 1997")
    return rounded(R.annual_ratios(rows).select("symbol", "fiscal_year_end", "revenue_growth"), "revenue_growth")


EVENTS = [("Brand#11", "1998-12-31"), ("Brand#23", "1999-12-31"), ("Brand#45", "1997-12-31")]


@query("SELECT symbol, fiscal_year_end, round(CASE WHEN (symbol, fiscal_year_end) NOT IN (" + ", ".join(f"('{s}', DATE '{d}')" for s, d in EVENTS) + ") THEN revenue_growth END, 6) + 0.0 AS revenue_growth, round(CASE WHEN (symbol, fiscal_year_end) NOT IN (" + ", ".join(f"('{s}', DATE '{d}')" for s, d in EVENTS) + ") THEN capex END, 6) + 0.0 AS capex FROM ratios")
def known_event_null(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.createDataFrame(EVENTS, "symbol string, d string").select("symbol", F.to_date("d").alias("fiscal_year_end"))
    out = R.without_known_events(R.annual_ratios(B.annual(spark, sf)), events)
    return rounded(out.select("symbol", "fiscal_year_end", "revenue_growth", "capex"), "revenue_growth", "capex")


@query("SELECT symbol, fiscal_year_end, round(total_assets, 6) + 0.0 AS total_assets FROM statements WHERE abs(total_assets - (share_capital + reserves + borrowings + 0.95 * cfo)) > 0.005 * greatest(abs(total_assets), 1)")
def balance_tie_out(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.annual(spark, sf).withColumn("total_liabilities_equity", F.col("share_capital") + F.col("reserves") + F.col("borrowings") + 0.95 * F.col("cfo"))
    return rounded(R.off_balance(rows).select("symbol", "fiscal_year_end", "total_assets"), "total_assets")


@query("SELECT date, symbol, round(eps, 6) + 0.0 AS eps, round(bvps, 6) + 0.0 AS bvps, round(shares, 2) + 0.0 AS shares FROM pit")
def pit_asof(spark: SparkSession, sf: str) -> DataFrame:
    rows = point_in_time(spark, sf, ["eps", "bvps", "shares"])
    return rounded(rounded(rows.select("date", "symbol", "eps", "bvps", "shares"), "eps", "bvps"), "shares", places=2)


@query("SELECT symbol, visible, lead(visible) OVER (PARTITION BY symbol ORDER BY visible) AS valid_to FROM (SELECT symbol, CAST(fiscal_year_end + INTERVAL 60 DAY AS DATE) AS visible FROM ratios)")
def pit_validity(spark: SparkSession, sf: str) -> DataFrame:
    return A.validity(A.visible_from(B.annual(spark, sf).select("symbol", "fiscal_year_end"))).select("symbol", "visible", "valid_to")


@query("SELECT date, symbol, round(market_cap / 1e9, 3) + 0.0 AS market_cap FROM caps")
def market_cap(spark: SparkSession, sf: str) -> DataFrame:
    rows = point_in_time(spark, sf, ["shares"]).withColumn("market_cap", F.col("price") * F.col("shares"))
    return rows.select("date", "symbol", r6(F.col("market_cap") / 1e9, 3).alias("market_cap"))


@query("SELECT p.date, p.symbol, " + ", ".join(f"round(p.{c}, 6) + 0.0 AS {c}" for c in ("leverage", "net_margin", "accruals")) + ", round(g.capex, 6) + 0.0 AS capex, round(g.revenue_growth, 6) + 0.0 AS revenue_growth FROM pit p JOIN growths g USING (date, symbol)")
def pit_factors(spark: SparkSession, sf: str) -> DataFrame:
    """The factors that are a ratio as it was last reported: leverage, profitability, accruals, capex, growth."""
    c = ["leverage", "net_margin", "accruals", "capex", "revenue_growth"]
    return rounded(point_in_time(spark, sf, c).select("date", "symbol", *c), *c)


_EP = zsql("ep", "(SELECT date, symbol, CASE WHEN price > 0 AND eps > 0 THEN eps / price END AS ep FROM pit)")
_BP = zsql("bp", "(SELECT date, symbol, CASE WHEN price > 0 AND bvps > 0 THEN bvps / price END AS bp FROM pit)")
_DY = zsql("dy", "(SELECT date, symbol, CASE WHEN price > 0 AND dps >= 0 THEN dps / price END AS dy FROM pit)")


@query(f"SELECT date, symbol, round(CASE WHEN (a.z IS NOT NULL)::INT + (b.z IS NOT NULL)::INT + (c.z IS NOT NULL)::INT >= 2 THEN (coalesce(a.z, 0) + coalesce(b.z, 0) + coalesce(c.z, 0)) / ((a.z IS NOT NULL)::INT + (b.z IS NOT NULL)::INT + (c.z IS NOT NULL)::INT) END, 6) + 0.0 AS value FROM {_EP} a JOIN {_BP} b USING (date, symbol) JOIN {_DY} c USING (date, symbol)")
def value_composite(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.value_composite(point_in_time(spark, sf, ["eps", "bvps", "dps"])).select("date", "symbol", "value"), "value")


@query(f"SELECT date, symbol, round(CASE WHEN a.z IS NOT NULL OR b.z IS NOT NULL THEN (coalesce(a.z, 0) + coalesce(b.z, 0)) / ((a.z IS NOT NULL)::INT + (b.z IS NOT NULL)::INT) END, 6) + 0.0 AS quality FROM {zsql('roa', '(SELECT date, symbol, roa FROM pit)')} a JOIN {zsql('roe', '(SELECT date, symbol, roe FROM pit)')} b USING (date, symbol)")
def quality_composite(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.quality_composite(point_in_time(spark, sf, ["roa", "roe"])).select("date", "symbol", "quality"), "quality")


@shared
def capped(spark: SparkSession, sf: str) -> DataFrame:
    return point_in_time(spark, sf, ["shares"]).withColumn("market_cap", F.col("price") * F.col("shares")).withColumn("size", X.log_size())


@query("SELECT date, symbol, CASE WHEN market_cap > 0 THEN CAST(row_number() OVER (PARTITION BY date, market_cap > 0 ORDER BY market_cap DESC, symbol) <= 10 AS DOUBLE) END AS top_flag FROM caps")
def topn_flag(spark: SparkSession, sf: str) -> DataFrame:
    return X.top_flag(capped(spark, sf), n=10, out="top_flag").select("date", "symbol", "top_flag")


_DECILE = "SELECT *, CASE WHEN size IS NOT NULL AND n >= 10 THEN CAST(greatest(1, ceil(10 * (r - 1) / (n - 1))) AS INTEGER) END AS size_decile FROM (SELECT *, row_number() OVER (PARTITION BY date, size IS NOT NULL ORDER BY size, symbol) AS r, count(size) OVER (PARTITION BY date) AS n FROM (SELECT *, CASE WHEN market_cap > 0 THEN ln(market_cap) END AS size FROM caps))"


@query(f"SELECT date, symbol, round(size, 6) + 0.0 AS size, size_decile FROM ({_DECILE})")
def size_decile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(X.size_decile(capped(spark, sf)).select("date", "symbol", "size", "size_decile"), "size")


@query("SELECT date, symbol, " + ", ".join(f"CAST(size_decile = {k} AS INTEGER) AS size_decile_{k}" for k in range(2, 11)) + f" FROM ({_DECILE})")
def decile_dummies(spark: SparkSession, sf: str) -> DataFrame:
    return X.decile_dummies(X.size_decile(capped(spark, sf))).select("date", "symbol", *[f"size_decile_{k}" for k in range(2, 11)])


@query(f"SELECT size_decile, count(ret) AS n, round(100 * avg(ret), 6) + 0.0 AS mean_pct FROM ({_DECILE}) WHERE size_decile IS NOT NULL GROUP BY size_decile")
def decile_means(spark: SparkSession, sf: str) -> DataFrame:
    return X.size_decile(capped(spark, sf)).where("size_decile IS NOT NULL").groupBy("size_decile").agg(F.count("ret").alias("n"), r6(100 * F.avg("ret")).alias("mean_pct"))


def flags(spark: SparkSession, sf: str) -> DataFrame:
    """A static 0/1 attribute of some symbols: whether any of its parts is of size 1."""
    return B.table(spark, sf, "part").where("p_size = 1").select(F.col("p_brand").alias("symbol"), F.lit(1).alias("flag")).distinct()


@query("SELECT date, symbol, CAST(coalesce(flag, 0) AS INTEGER) AS flag FROM grid LEFT JOIN (SELECT DISTINCT p_brand AS symbol, 1 AS flag FROM part WHERE p_size = 1) USING (symbol)")
def static_flag(spark: SparkSession, sf: str) -> DataFrame:
    grid = P.full_grid(B.prices(spark, sf)).select("date", "symbol")
    return X.static_attributes(grid, flags(spark, sf), {"flag": 0})


@query("SELECT date, symbol, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in B.REGION_COLUMNS) + " FROM grid JOIN shares_by_region USING (symbol)")
def industry_daily(spark: SparkSession, sf: str) -> DataFrame:
    grid = P.full_grid(B.prices(spark, sf)).select("date", "symbol")
    return rounded(X.static_attributes(grid, B.industries(spark, sf)), *B.REGION_COLUMNS)


@query("""SELECT symbol, quarter_end, announced, round(change, 4) + 0.0 AS change, round(CASE WHEN n >= 3 AND dev > 0 THEN change / dev END, 6) + 0.0 AS sue FROM (
    SELECT *, count(change) OVER v AS n, stddev_samp(change) OVER v AS dev, CAST(quarter_end + INTERVAL 45 DAY AS DATE) AS announced FROM (
      SELECT symbol, quarter_end, profit - lag(profit, 4) OVER (PARTITION BY symbol ORDER BY quarter_end) AS change FROM (
        SELECT symbol, last_day(CAST(date_trunc('quarter', day) AS DATE) + INTERVAL 2 MONTH) AS quarter_end, sum(ext * (1 - disc) - qty * retail) AS profit FROM lines GROUP BY ALL))
    WINDOW v AS (PARTITION BY symbol ORDER BY quarter_end ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))""")
def seasonal_surprise(spark: SparkSession, sf: str) -> DataFrame:
    li = B.lines(spark, sf).withColumn("quarter_end", F.last_day(F.add_months(F.trunc("day", "quarter"), 2)))
    quarterly = li.groupBy("symbol", "quarter_end").agg(F.sum(F.col("ext") * (1 - F.col("disc")) - F.col("qty") * F.col("retail")).alias("net_profit"))
    out = X.seasonal_surprise(quarterly).select("symbol", "quarter_end", "announced", "change", "sue")
    return rounded(rounded(out, "change", places=4), "sue")


STYLES = ["beta", "idio_vol", "momentum", "size", "value", "leverage", "quality", "profitability", "liquidity"]


@shared
def exposures(spark: SparkSession, sf: str) -> DataFrame:
    """The exposure panel: standardized styles, fractional industries, the flag, labels and the market value."""
    rows = point_in_time(spark, sf).join(F.broadcast(B.market(spark, sf).select("date", "market_ret")), "date")
    rows = rows.withColumn("market_cap", F.col("price") * F.col("shares")).withColumn("size", X.log_size()).withColumn("profitability", F.col("net_margin"))
    # all windows by symbol first, then all by date: two shuffles for the whole panel
    rows = X.liquidity(X.momentum(X.rolling_beta(rows, n=N), lookback=N, skip=1), volume="volume", n=N)
    rows = X.top_flag(X.size_decile(X.quality_composite(X.value_composite(rows))), n=10, out="top_flag")
    rows = S.winsor_zscore(rows, *STYLES)
    rows = X.static_attributes(X.static_attributes(rows, F.broadcast(B.industries(spark, sf))), F.broadcast(flags(spark, sf)), {"flag": 0})
    return rows.select("date", "symbol", *B.REGION_COLUMNS, *STYLES, "top_flag", "flag", "size_decile", "market_cap", "ret")


_Z = {
    "beta": f"(SELECT date, symbol, beta FROM ({_BETA}))",
    "momentum": f"(SELECT date, symbol, lag(price, 1) OVER w / nullif(lag(price, {N}) OVER w, 0) - 1 AS momentum FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY date))",
    "size": "(SELECT date, symbol, CASE WHEN market_cap > 0 THEN ln(market_cap) END AS size FROM caps)",
    "leverage": "(SELECT date, symbol, leverage FROM pit)",
}


CTE["expo"] = "SELECT date, symbol, " + ", ".join(B.REGION_COLUMNS) + ", " + ", ".join(f"{k}.z AS {k}" for k in _Z) + ", market_cap, ret FROM caps JOIN shares_by_region USING (symbol) " + " ".join(f"JOIN {zsql(k, s)} {k} USING (date, symbol)" for k, s in _Z.items())


@query("SELECT date, symbol, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in [*B.REGION_COLUMNS, *_Z]) + ", round(market_cap / 1e9, 3) + 0.0 AS market_cap, round(ret, 6) + 0.0 AS ret FROM expo")
def exposure_panel(spark: SparkSession, sf: str) -> DataFrame:
    out = exposures(spark, sf).select("date", "symbol", *B.REGION_COLUMNS, *_Z, "market_cap", "ret")
    return rounded(out, *B.REGION_COLUMNS, *_Z, "ret").withColumn("market_cap", r6(F.col("market_cap") / 1e9, 3))
