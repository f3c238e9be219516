"""The registry's tables and its SQL building blocks.

The engine works on panels of prices; the test tables hold orders. A brand (``p_brand``) plays the symbol, the price
is revenue over quantity of what shipped in a period, the market is all brands together, statements are the sums of
a calendar year, and industries are shares of revenue by the supplier's region. ``CTE`` says the same in SQL.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import panel as P

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = with_ctes(sql)
        return f

    return register


#: Intermediate tables that several queries use, by application: written once, then read.
_SHARED: dict[tuple, DataFrame] = {}
_SCRATCH: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, which driver and executors share.

    Only a session on one machine may leave it unset; a folder of this process is used then.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir is unset, and this cluster's machines share no other folder")
    if "dir" not in _SCRATCH:
        _SCRATCH["dir"] = tempfile.mkdtemp(prefix="quantloom-plans-")
    return "file://" + _SCRATCH["dir"]


def shared(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Write what ``f(spark, sf, ...)`` returns as a table and give that to all callers: plans that use it begin with a
    scan instead of its whole lineage, and a lost executor costs a re-read."""

    @wraps(f)
    def get(spark: SparkSession, sf: str, *args) -> DataFrame:
        key = (spark.sparkContext.applicationId, f.__module__, f.__name__, sf, args)
        if key not in _SHARED:
            df = f(spark, sf, *args)
            path = f"{scratch(spark)}/quantloom-{f.__name__}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
            _SHARED[key] = spark.read.schema(df.schema).parquet(path)
        return _SHARED[key]

    return get


def forget() -> None:
    """Let the next query compute its intermediate tables again."""
    _SHARED.clear()


def r6(c: str | Column, places: int = 6) -> Column:
    """Rounded, without a negative zero: engines add in different orders."""
    return F.round(F.col(c) if isinstance(c, str) else c, places) + F.lit(0.0)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: r6(c, places) for c in columns})


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("symbol"), F.col("p_retailprice").alias("retail"))
    line = table(spark, sf, "lineitem").select("l_partkey", F.col("l_suppkey").alias("suppkey"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("ext"), F.col("l_discount").alias("disc"), F.col("l_tax").alias("tax"), F.to_date("l_shipdate").alias("day"))
    return line.join(part, line["l_partkey"] == part["p_partkey"]).drop("l_partkey", "p_partkey")


@shared
def prices(spark: SparkSession, sf: str, unit: str = "month") -> DataFrame:
    date = F.col("day") if unit == "day" else F.trunc("day", unit)
    return lines(spark, sf).groupBy("symbol", date.alias("date")).agg((F.sum("ext") / F.sum("qty")).alias("price"), F.sum("qty").alias("volume"))


@shared
def panel(spark: SparkSession, sf: str, unit: str = "month") -> DataFrame:
    """The full grid with price, volume and ret."""
    return P.with_returns(P.full_grid(prices(spark, sf, unit)))


@shared
def market(spark: SparkSession, sf: str, unit: str = "month") -> DataFrame:
    """(date, price, market_ret) of all brands together."""
    line = table(spark, sf, "lineitem")
    date = F.to_date("l_shipdate") if unit == "day" else F.trunc(F.to_date("l_shipdate"), unit)
    px = line.groupBy(date.alias("date")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price")).withColumn("symbol", F.lit("MARKET"))
    return P.with_returns(px, out="market_ret").drop("symbol")


@shared
def annual(spark: SparkSession, sf: str) -> DataFrame:
    li = lines(spark, sf).withColumn("fiscal_year_end", F.make_date(F.year("day"), F.lit(12), F.lit(31)))
    net = F.col("ext") * (1 - F.col("disc"))
    sums = li.groupBy("symbol", "fiscal_year_end").agg(
        F.sum(net).alias("sales"),
        F.sum(F.col("qty") * F.col("retail")).alias("cogs"),
        F.sum(net * F.col("tax")).alias("tax"),
        F.sum(F.col("ext") * F.col("disc")).alias("borrowings"),
        (1e7 * F.sum("qty")).alias("shares"),
    )
    return sums.select(
        "symbol",
        "fiscal_year_end",
        "sales",
        (F.col("sales") - F.col("cogs") - F.col("tax")).alias("net_profit"),
        (2.0 * F.col("cogs")).alias("total_assets"),
        (0.25 * F.col("cogs")).alias("share_capital"),
        (0.75 * F.col("cogs")).alias("reserves"),
        "borrowings",
        (0.5 * F.col("cogs")).alias("net_block"),
        (0.05 * F.col("cogs")).alias("depreciation"),
        (F.col("sales") - F.col("cogs")).alias("cfo"),
        "shares",
        (0.1 * F.col("tax")).alias("dividend"),
    )


@shared
def industries(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, one column a region): shares of revenue, which sum to one."""
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("suppkey"), "s_nationkey")
    nation = table(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf, "region").select("r_regionkey", "r_name")
    where = supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")).select("suppkey", "r_name")
    li = lines(spark, sf).join(where, "suppkey")
    return li.groupBy("symbol").agg(*[(F.sum(F.when(F.col("r_name") == r, F.col("ext")).otherwise(0.0)) / F.sum("ext")).alias(r.lower().replace(" ", "_")) for r in REGIONS])


REGION_COLUMNS = [r.lower().replace(" ", "_") for r in REGIONS]

CTE: dict[str, str] = {
    "lines": "SELECT p_brand AS symbol, p_retailprice AS retail, l_suppkey AS suppkey, l_quantity AS qty, l_extendedprice AS ext, l_discount AS disc, l_tax AS tax, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN part ON l_partkey = p_partkey",
    "px": "SELECT symbol, CAST(date_trunc('month', day) AS DATE) AS date, sum(ext) / sum(qty) AS price, sum(qty) AS volume FROM lines GROUP BY ALL",
    "grid": "SELECT d.date, s.symbol, x.price, x.volume FROM (SELECT DISTINCT date FROM px) d CROSS JOIN (SELECT DISTINCT symbol FROM px) s LEFT JOIN px x ON x.date = d.date AND x.symbol = s.symbol",
    "padded": "SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pad FROM grid",
    "rets": "SELECT date, symbol, price, volume, pad / nullif(lag(pad) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS ret FROM padded",
    "dpx": "SELECT symbol, day AS date, sum(ext) / sum(qty) AS price, sum(qty) AS volume FROM lines GROUP BY ALL",
    "dgrid": "SELECT d.date, s.symbol, x.price, x.volume FROM (SELECT DISTINCT date FROM dpx) d CROSS JOIN (SELECT DISTINCT symbol FROM dpx) s LEFT JOIN dpx x ON x.date = d.date AND x.symbol = s.symbol",
    "dpadded": "SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pad FROM dgrid",
    "drets": "SELECT date, symbol, price, volume, pad / nullif(lag(pad) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS ret FROM dpadded",
    "mktpx": "SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date, sum(l_extendedprice) / sum(l_quantity) AS price FROM lineitem GROUP BY ALL",
    "mkt": "SELECT date, price, price / lag(price) OVER (ORDER BY date) - 1 AS market_ret FROM mktpx",
    "sums": "SELECT symbol, make_date(CAST(year(day) AS BIGINT), 12, 31) AS fiscal_year_end, sum(ext * (1 - disc)) AS sales, sum(qty * retail) AS cogs, sum(ext * (1 - disc) * tax) AS tax, sum(ext * disc) AS borrowings, 1e7 * sum(qty) AS shares FROM lines GROUP BY ALL",
    "statements": "SELECT symbol, fiscal_year_end, sales, sales - cogs - tax AS net_profit, 2.0 * cogs AS total_assets, 0.25 * cogs AS share_capital, 0.75 * cogs AS reserves, borrowings, 0.5 * cogs AS net_block, 0.05 * cogs AS depreciation, sales - cogs AS cfo, shares, 0.1 * tax AS dividend FROM sums",
    "ratios": """SELECT symbol, fiscal_year_end, shares, borrowings / nullif(share_capital + reserves, 0) AS leverage, net_profit / nullif(total_assets, 0) AS roa,
        net_profit / nullif(share_capital + reserves, 0) AS roe, net_profit / nullif(sales, 0) AS net_margin, net_profit / (shares / 1e7) AS eps,
        (share_capital + reserves) / (shares / 1e7) AS bvps, dividend / (shares / 1e7) AS dps,
        (net_block - lag(net_block) OVER w + depreciation) / nullif(lag(total_assets) OVER w, 0) AS capex, sales / nullif(lag(sales) OVER w, 0) - 1 AS revenue_growth,
        (net_profit - cfo) / nullif(total_assets, 0) AS accruals
        FROM statements WINDOW w AS (PARTITION BY symbol ORDER BY fiscal_year_end)""",
    "pit": "SELECT g.date, g.symbol, g.price, g.volume, g.ret, r.shares, r.leverage, r.roa, r.roe, r.net_margin, r.eps, r.bvps, r.dps, r.accruals FROM rets g ASOF LEFT JOIN (SELECT *, fiscal_year_end + INTERVAL 60 DAY AS visible FROM ratios) r ON g.symbol = r.symbol AND g.date >= r.visible",
    "growths": "SELECT g.date, g.symbol, r.capex, r.revenue_growth FROM rets g ASOF LEFT JOIN (SELECT *, fiscal_year_end + INTERVAL 60 DAY AS visible FROM ratios WHERE capex IS NOT NULL) r ON g.symbol = r.symbol AND g.date >= r.visible",
    "caps": "SELECT date, symbol, price, ret, price * shares AS market_cap FROM pit",
    "shares_by_region": "SELECT symbol, " + ", ".join(f"sum(CASE WHEN r_name = '{r}' THEN ext ELSE 0 END) / sum(ext) AS {c}" for r, c in zip(REGIONS, REGION_COLUMNS, strict=True)) + " FROM lines JOIN supplier ON suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY symbol",
}


def with_ctes(body: str) -> str:
    """``body`` with all building blocks that it names, directly or not, in front."""
    needed: set[str] = set()

    def add(text: str) -> None:
        for name, sql in CTE.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                add(sql)

    add(body)
    head = ", ".join(f"{n} AS ({s})" for n, s in CTE.items() if n in needed)
    body = body.strip()
    if not head:
        return body
    start = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    return f"WITH {start[1] or ''}{head}, {body[start.end():]}" if start else f"WITH {head} {body}"


def zsql(value: str, source: str, by: str = "date", extra: str = "") -> str:
    """SQL of the winsorized z-score of ``value`` as ``z``, a subquery with the source's columns."""
    low, high = (f"quantile_cont({value}, {q}) OVER (PARTITION BY {by})" for q in (0.01, 0.99))
    clip = f"(SELECT *, CASE WHEN {value} IS NOT NULL THEN least(greatest({value}, {low}), {high}) END AS clipped FROM {source})"
    return f"(SELECT *, CASE WHEN count(clipped) OVER (PARTITION BY {by}) >= 2 AND stddev_samp(clipped) OVER (PARTITION BY {by}) > 0 THEN (clipped - avg(clipped) OVER (PARTITION BY {by})) / stddev_samp(clipped) OVER (PARTITION BY {by}) END AS z FROM {clip})"
