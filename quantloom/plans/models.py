"""Queries of regressions, inference and risk.

Factors here are the five regions: a brand is exposed by its share of revenue, a region's return is the mean return
of the brands weighted by those shares, and what is left of a brand's return is its residual.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.operators import factors as X
from quantloom.operators import inference as I
from quantloom.operators import portfolio as PF
from quantloom.operators import regression as G
from quantloom.operators import risk as K
from quantloom.plans import base as B
from quantloom.plans.base import CTE, query, r6, rounded, shared
from quantloom.plans.factors import capped, exposures

HALF = 12.0
_COLS = ", ".join(B.REGION_COLUMNS)

CTE |= {
    "cal": "SELECT date, lead(date) OVER (ORDER BY date) AS target_date FROM (SELECT DISTINCT date FROM px)",
    "regrows": "SELECT c.target_date, e.symbol, e.market_cap, ln(e.market_cap) AS size, r.ret AS raw_return, r.ret - 0.055 / 12 AS y FROM caps e JOIN cal c ON c.date = e.date JOIN rets r ON r.date = c.target_date AND r.symbol = e.symbol",
    "fitrows": "SELECT * FROM regrows WHERE y IS NOT NULL AND market_cap > 0 AND NOT coalesce(abs(raw_return) > 0.4, FALSE)",
    "xlong": f"SELECT symbol, factor, x FROM shares_by_region UNPIVOT (x FOR factor IN ({_COLS}))",
    "fret": "SELECT date, factor, sum(x * ret) / sum(x) AS ret FROM rets JOIN xlong USING (symbol) WHERE ret IS NOT NULL GROUP BY ALL",
    "resid": "SELECT r.date, r.symbol, r.ret - sum(x * f.ret) AS residual FROM rets r JOIN xlong USING (symbol) JOIN fret f ON f.date = r.date AND f.factor = xlong.factor WHERE r.ret IS NOT NULL GROUP BY r.date, r.symbol, r.ret",
}


def nw_sql(source: str, key: str, value: str = "ret") -> str:
    """SQL of the robust mean: key, n, mean, nw_se, nw_t."""
    return f"""(WITH a AS (SELECT {key}, date, {value} AS v, row_number() OVER (PARTITION BY {key} ORDER BY date) AS i, avg({value}) OVER (PARTITION BY {key}) AS m, count(*) OVER (PARTITION BY {key}) AS n FROM {source} WHERE {value} IS NOT NULL),
    b AS (SELECT *, v - m AS u, greatest(1, floor(4 * pow(n / 100.0, 2.0 / 9.0))) AS lags FROM a),
    c AS (SELECT p.{key}, p.n, p.m, sum((CASE WHEN q.i = p.i THEN 1.0 ELSE 2.0 * (1.0 - (p.i - q.i) / (p.lags + 1.0)) END) * p.u * q.u) AS s FROM b p JOIN b q ON p.{key} = q.{key} AND q.i <= p.i AND q.i >= p.i - p.lags GROUP BY p.{key}, p.n, p.m)
    SELECT {key}, n, m AS mean, sqrt(greatest(s, 0)) / n AS nw_se, m / nullif(sqrt(greatest(s, 0)) / n, 0) AS nw_t FROM c)"""


@shared
def regression_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = capped(spark, sf)
    return G.aligned(rows.select("date", "symbol", "market_cap", "size"), rows.select("date", "symbol", "ret"), days=12)


@query("SELECT target_date, symbol, round(raw_return, 6) + 0.0 AS raw_return, round(y, 6) + 0.0 AS y, round(size, 6) + 0.0 AS size FROM regrows")
def forward_returns(spark: SparkSession, sf: str) -> DataFrame:
    """Exposures of a month with the excess return of the next month of the shared calendar."""
    return rounded(regression_rows(spark, sf).select("target_date", "symbol", "raw_return", "y", "size"), "raw_return", "y", "size")


@query("SELECT target_date, symbol, round(raw_return, 6) + 0.0 AS raw_return FROM regrows WHERE abs(raw_return) > 0.1")
def outlier_flagged(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.split_outliers(regression_rows(spark, sf), 0.1)[1].select("target_date", "symbol", "raw_return"), "raw_return")


def fit_rows(spark: SparkSession, sf: str) -> DataFrame:
    return G.complete_cases(G.split_outliers(regression_rows(spark, sf))[0], ["size"])


@query("""SELECT target_date AS date, n, round(slope, 6) + 0.0 AS slope, round((sy - slope * sx) / sw, 5) + 0.0 AS intercept FROM (SELECT *, (sw * sxy - sx * sy) / nullif(sw * sxx - sx * sx, 0) AS slope FROM (
    SELECT target_date, count(*) AS n, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy FROM (SELECT target_date, sqrt(market_cap) / 1e7 AS w, size - 32 AS x, y FROM fitrows) GROUP BY target_date))""")
def wls_univariate(spark: SparkSession, sf: str) -> DataFrame:
    # weights and exposures are scaled and centred first: the closed form then loses no digits
    rows = fit_rows(spark, sf).withColumns({"market_cap": F.col("market_cap") / 1e14, "size": F.col("size") - 32})
    out = G.univariate_fit(rows, "size")
    return out.select("date", "n", r6("slope").alias("slope"), r6("intercept", 5).alias("intercept"))


@query("SELECT target_date AS date, grp AS factor, round(sum(w * y) / sum(w), 6) + 0.0 AS ret FROM (SELECT target_date, y, sqrt(market_cap) AS w, substr(symbol, 7, 1) AS grp FROM fitrows) GROUP BY ALL")
def wls_onehot_fwl(spark: SparkSession, sf: str) -> DataFrame:
    rows = fit_rows(spark, sf).withColumn("grp", F.substring("symbol", 7, 1))
    return rounded(G.group_means_fit(rows, "grp"), "ret")


@query("SELECT target_date AS date, CASE WHEN count(*) < 20 THEN 'skipped_low_n' WHEN stddev_samp(y) < 1e-6 THEN 'degenerate' ELSE 'fitted' END AS status, count(*) AS n FROM fitrows GROUP BY target_date")
def coverage_status(spark: SparkSession, sf: str) -> DataFrame:
    fits = G.cross_sectional_fits(fit_rows(spark, sf).withColumn("one", F.lit(1.0)), ["one", "size"], least=20)
    return G.fit_statistics(fits).select("date", "status", "n")


@query("SELECT target_date AS date, factor, round(ret, 6) + 0.0 AS ret FROM (SELECT target_date, grp AS factor, sum(w * y) / sum(w) AS ret FROM (SELECT target_date, y, sqrt(market_cap) AS w, substr(symbol, 7, 1) AS grp FROM fitrows) GROUP BY ALL)")
def wls_groups_fitted(spark: SparkSession, sf: str) -> DataFrame:
    """The general fit on one-hot groups, which must give each group's weighted mean."""
    names = [str(k) for k in range(1, 10)]
    rows = fit_rows(spark, sf).withColumns({f"g{k}": (F.substring("symbol", 7, 1) == k).cast("double") for k in names})
    fits = G.cross_sectional_fits(rows, [f"g{k}" for k in names], least=5)
    out = G.factor_returns(fits).withColumn("factor", F.substring("factor", 2, 1))
    there = rows.select(F.col("target_date").alias("date"), F.substring("symbol", 7, 1).alias("factor")).distinct()
    return rounded(out.join(there, ["date", "factor"], "left_semi"), "ret")


DESIGN = [*B.REGION_COLUMNS, "beta", "momentum", "size", "leverage"]


@shared
def model_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = exposures(spark, sf)
    joined = G.aligned(rows.drop("ret"), rows.select("date", "symbol", "ret"), days=12)
    return G.complete_cases(G.split_outliers(joined)[0], DESIGN)


@shared
def model_fits(spark: SparkSession, sf: str) -> DataFrame:
    return G.cross_sectional_fits(model_rows(spark, sf), DESIGN, least=15)


def solved_sql(name: str, cells: str, keys: str, size: int) -> str:
    """SQL that solves normal equations by Gauss-Jordan steps: ``name`` has (keys, i, v), the solution.

    ``cells`` has (keys, i, j, v): the matrix with its right side as column ``size`` + 1. Matrices are of full rank.
    """
    on = lambda a: " AND ".join(f"{a}.{k} = g.{k}" for k in keys.split(", "))
    own = ", ".join(f"g.{k}" for k in keys.split(", "))
    return f"""{name}_step AS (SELECT 0 AS k, {keys}, i, j, v FROM {cells} UNION ALL
        SELECT g.k + 1, {own}, g.i, g.j, CASE WHEN g.i = g.k + 1 THEN g.v / p.v ELSE g.v - c.v * r.v / p.v END
        FROM {name}_step g JOIN {name}_step p ON {on('p')} AND p.i = g.k + 1 AND p.j = g.k + 1 JOIN {name}_step c ON {on('c')} AND c.i = g.i AND c.j = g.k + 1 JOIN {name}_step r ON {on('r')} AND r.i = g.k + 1 AND r.j = g.j
        WHERE g.k < {size}), {name} AS (SELECT {keys}, i, v FROM {name}_step WHERE k = {size} AND j = {size} + 1)"""


_LIST = "[" + ", ".join(DESIGN) + "]"
_DESIGN_NAMES = "[" + ", ".join(f"'{c}'" for c in DESIGN) + "]"
_FIT = f"""WITH RECURSIVE m AS (SELECT target_date AS date, symbol, y, sqrt(market_cap) AS w, {_LIST} AS x FROM modelrows),
    ok AS (SELECT date, count(*) AS n, CASE WHEN count(*) < 15 THEN 'skipped_low_n' WHEN stddev_samp(y) < 1e-6 THEN 'degenerate' ELSE 'fitted' END AS status FROM m GROUP BY date),
    cells AS (SELECT date, i.i AS i, j.i AS j, sum(w * x[i.i] * CASE WHEN j.i = {len(DESIGN) + 1} THEN y ELSE x[j.i] END) AS v FROM m JOIN ok USING (date), range(1, {len(DESIGN) + 1}) i(i), range(1, {len(DESIGN) + 2}) j(i) WHERE status = 'fitted' GROUP BY ALL),
    {solved_sql("coef", "cells", "date", len(DESIGN))},
    fitted AS (SELECT m.date, m.symbol, any_value(m.y) AS y, any_value(m.w) AS w, sum(m.x[c.i] * c.v) AS fit FROM m JOIN coef c ON c.date = m.date GROUP BY m.date, m.symbol),
    r2 AS (SELECT *, 1 - (1 - r2) * (n - 1) / (n - {len(DESIGN)}) AS adj_r2 FROM (SELECT date, count(*) AS n, 1 - sum(w * (y - fit) * (y - fit)) / sum(w * (y - my) * (y - my)) AS r2 FROM (SELECT *, sum(w * y) OVER (PARTITION BY date) / sum(w) OVER (PARTITION BY date) AS my FROM fitted) GROUP BY date))
    """
CTE["modelrows"] = f"SELECT c.target_date, e.*, r.ret - 0.055 / 12 AS y FROM (SELECT * EXCLUDE (ret) FROM expo) e JOIN cal c ON c.date = e.date JOIN rets r ON r.date = c.target_date AND r.symbol = e.symbol WHERE r.ret IS NOT NULL AND abs(r.ret) <= 0.4 AND market_cap > 0 AND " + " AND ".join(f"{c} IS NOT NULL" for c in DESIGN)


@query(f"{_FIT} SELECT date, {_DESIGN_NAMES}[i] AS factor, round(v, 6) + 0.0 AS ret FROM coef")
def wls_full(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.factor_returns(model_fits(spark, sf)), "ret")


@query(f"{_FIT} SELECT date, status, o.n, round(r2, 6) + 0.0 AS r2, round(adj_r2, 6) + 0.0 AS adj_r2 FROM ok o LEFT JOIN r2 USING (date)")
def r2_daily(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.fit_statistics(model_fits(spark, sf)), "r2", "adj_r2")


@query(f"{_FIT} SELECT date, symbol, round(y - fit, 6) + 0.0 AS residual, round(fit, 6) + 0.0 AS fitted FROM fitted")
def residuals(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(G.residuals(model_fits(spark, sf)), "residual", "fitted")


def regions(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, factor, x)."""
    return K.long_exposures(B.industries(spark, sf), B.REGION_COLUMNS)


@shared
def region_returns(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.panel(spark, sf).where("ret IS NOT NULL").join(F.broadcast(regions(spark, sf)), "symbol")
    return rows.groupBy("date", "factor").agg((F.sum(F.col("x") * F.col("ret")) / F.sum("x")).alias("ret"))


@shared
def region_residuals(spark: SparkSession, sf: str) -> DataFrame:
    fitted = region_returns(spark, sf).join(F.broadcast(regions(spark, sf)), "factor").groupBy("date", "symbol").agg(F.sum(F.col("x") * F.col("ret")).alias("fitted"))
    return B.panel(spark, sf).where("ret IS NOT NULL").join(fitted, ["date", "symbol"]).select("date", "symbol", (F.col("ret") - F.col("fitted")).alias("residual"))


@query("SELECT date, factor, round(ret, 6) + 0.0 AS ret FROM fret")
def region_factor_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(region_returns(spark, sf), "ret")


@query(f"SELECT f.factor, f.n, round(f.mean, 6) + 0.0 AS mean, round(f.nw_se, 6) + 0.0 AS nw_se, round(f.nw_t, 5) + 0.0 AS nw_t, round(p.t, 5) + 0.0 AS t, round(p.pos, 6) + 0.0 AS pct_positive FROM {nw_sql('fret', 'factor')} f JOIN (SELECT factor, avg(ret) / (stddev_samp(ret) / sqrt(count(*))) AS t, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS pos FROM fret GROUP BY factor) p USING (factor)")
def newey_west_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = I.summary(region_returns(spark, sf))
    return rounded(rounded(out.select("factor", "n", "mean", "nw_se", "nw_t", "t", "pct_positive"), "mean", "nw_se", "pct_positive"), "nw_t", "t", places=5)


@query("SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, round(product(1 + ret) - 1, 5) + 0.0 AS ret FROM drets WHERE ret IS NOT NULL GROUP BY ALL")
def monthly_compounding(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.monthly_compounded(B.panel(spark, sf, "day"), "symbol"), "ret", places=5)


CTE["macroends"] = "SELECT o_orderpriority AS name, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, arg_max(total, day) AS price FROM (SELECT o_orderpriority, o_orderdate, CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE)) AS total FROM orders) GROUP BY ALL"
CTE["macro"] = """SELECT name, month, price / lag(price) OVER (PARTITION BY name ORDER BY month) - 1 AS change FROM (
    SELECT name, month, last_value(price IGNORE NULLS) OVER (PARTITION BY name ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price FROM (
      SELECT s.name, CAST(s.month AS DATE) AS month, e.price FROM (SELECT name, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS month FROM macroends GROUP BY name) s LEFT JOIN macroends e ON e.name = s.name AND e.month = s.month))"""


def macro_prices(spark: SparkSession, sf: str) -> DataFrame:
    """(name, date, price): value ordered on a day, by priority."""
    orders = B.table(spark, sf, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("name"), F.to_date("o_orderdate").alias("date")).agg(F.sum("o_totalprice").alias("price"))


@query("SELECT name, month, round(change, 6) + 0.0 AS change FROM macro")
def macro_monthly(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(I.monthly_change(macro_prices(spark, sf)), "change")


CTE["macropairs"] = "SELECT m.name, f.factor, f.date, m.change AS x, f.ret AS y FROM macro m JOIN fret f ON f.date = CAST(m.month + INTERVAL 1 MONTH AS DATE) WHERE m.change IS NOT NULL AND f.ret IS NOT NULL"


def slope_sql(source: str, keys: str, least: int = 24) -> str:
    """SQL of the robust slope: keys, n, slope, intercept, nw_se, nw_t, r2."""
    on = " AND ".join(f"p.{k} = q.{k}" for k in keys.split(", "))
    pk = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f"""(WITH a AS (SELECT {keys}, date, x, y, row_number() OVER (PARTITION BY {keys} ORDER BY date) AS i, count(*) OVER w AS n, avg(x) OVER w AS mx, avg(y) OVER w AS my, covar_pop(y, x) OVER w / nullif(var_pop(x) OVER w, 0) AS b, var_pop(x) OVER w * count(*) OVER w AS sxx, pow(corr(x, y) OVER w, 2) AS r2 FROM {source} WINDOW w AS (PARTITION BY {keys})),
    u AS (SELECT *, (x - mx) * (y - my - b * (x - mx)) AS u, greatest(1, floor(4 * pow(n / 100.0, 2.0 / 9.0))) AS lags FROM a WHERE n >= {least})
    SELECT {pk}, p.n, any_value(p.b) AS slope, any_value(p.my - p.b * p.mx) AS intercept, any_value(p.r2) AS r2, sqrt(greatest(sum((CASE WHEN q.i = p.i THEN 1.0 ELSE 2.0 * (1.0 - (p.i - q.i) / (p.lags + 1.0)) END) * p.u * q.u), 0)) / any_value(p.sxx) AS nw_se
    FROM u p JOIN u q ON {on} AND q.i <= p.i AND q.i >= p.i - p.lags GROUP BY {pk}, p.n)"""


@query(f"SELECT name, factor, n, round(slope, 6) + 0.0 AS slope, round(intercept, 6) + 0.0 AS intercept, round(nw_se, 6) + 0.0 AS nw_se, round(slope / nullif(nw_se, 0), 5) + 0.0 AS nw_t, round(r2, 6) + 0.0 AS r2 FROM {slope_sql('macropairs', 'name, factor')}")
def macro_regression(spark: SparkSession, sf: str) -> DataFrame:
    macro = I.monthly_change(macro_prices(spark, sf)).select("name", F.add_months("month", 1).alias("date"), "change")
    pairs = macro.join(region_returns(spark, sf), "date")
    out = I.newey_west_slope(pairs, ["name", "factor"], "change", "ret")
    return rounded(rounded(out, "slope", "intercept", "nw_se", "r2"), "nw_t", places=5)


_K = "(1.0 / (1.0 + 0.3275911 * abs(t) / sqrt(2)))"
_P = f"({_K} * (0.254829592 + {_K} * (-0.284496736 + {_K} * (1.421413741 + {_K} * (-1.453152027 + {_K} * 1.061405429))))) * exp(-t * t / 2)"


@query(f"SELECT name, factor, round(p, 6) + 0.0 AS p, p < 0.05 AS significant, p < 0.05 / 25 AS bonferroni FROM (SELECT name, factor, {_P} AS p FROM (SELECT name, factor, slope / nullif(nw_se, 0) AS t FROM {slope_sql('macropairs', 'name, factor')}))")
def macro_bonferroni(spark: SparkSession, sf: str) -> DataFrame:
    factors = region_returns(spark, sf).withColumnRenamed("date", "month")
    out = I.macro_sweep(I.monthly_change(macro_prices(spark, sf)), factors)
    return rounded(out.select("name", "factor", "p", "significant", "bonferroni"), "p")


CTE |= {
    "ages": "SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS age FROM (SELECT DISTINCT date FROM fret)",
    "aged": f"SELECT f.*, pow(0.5, age / {HALF}) AS w FROM fret f JOIN ages USING (date)",
    "fmean": "SELECT factor, sum(w * ret) / sum(w) AS mean FROM aged GROUP BY factor",
    "fcov": """SELECT row, col, s / sw * sw * sw / (sw * sw - sww) AS cov FROM (SELECT row, col, sum(w) AS sw, sum(w * w) AS sww, sum(w * (x - mx) * (y - my)) AS s FROM (
        SELECT a.factor AS row, b.factor AS col, a.w, a.ret AS x, b.ret AS y, sum(a.w * a.ret) OVER g / sum(a.w) OVER g AS mx, sum(a.w * b.ret) OVER g / sum(a.w) OVER g AS my FROM aged a JOIN aged b ON a.date = b.date WINDOW g AS (PARTITION BY a.factor, b.factor)) GROUP BY row, col)""",
    "raged": f"SELECT r.*, pow(0.5, age / {HALF}) AS w FROM resid r JOIN (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS age FROM (SELECT DISTINCT date FROM resid)) USING (date)",
    "spec": """SELECT symbol, sqrt(s / sw * sw * sw / (sw * sw - sww) * 12) AS specific_risk FROM (SELECT symbol, sum(w) AS sw, sum(w * w) AS sww, sum(w * (residual - m) * (residual - m)) AS s FROM (
        SELECT *, sum(w * residual) OVER (PARTITION BY symbol) / sum(w) OVER (PARTITION BY symbol) AS m FROM raged) GROUP BY symbol)""",
    "expf": f"SELECT factor, mean, nw_t, least(greatest((abs(nw_t) - 0.2) / (3.0 - 0.2), 0.0), 1.0) AS shrinkage FROM fmean JOIN (SELECT factor, nw_t FROM {nw_sql('fret', 'factor')}) USING (factor)",
    "mus": "SELECT symbol, sum(x * mean * shrinkage) AS mu FROM xlong JOIN expf USING (factor) GROUP BY symbol",
    "scov": "SELECT a.symbol AS row, b.symbol AS col, sum(a.x * c.cov * b.x) + CASE WHEN a.symbol = b.symbol THEN any_value(s.specific_risk * s.specific_risk / 12) ELSE 0 END AS cov FROM xlong a JOIN fcov c ON a.factor = c.row JOIN xlong b ON b.factor = c.col JOIN spec s ON s.symbol = a.symbol GROUP BY a.symbol, b.symbol",
}


@shared
def factor_covariance(spark: SparkSession, sf: str) -> DataFrame:
    return K.ewma_covariance(region_returns(spark, sf), halflife=HALF)


@shared
def specific(spark: SparkSession, sf: str) -> DataFrame:
    return K.ewma_specific_risk(region_residuals(spark, sf), halflife=HALF, days=12)


@shared
def expected(spark: SparkSession, sf: str) -> DataFrame:
    series = region_returns(spark, sf)
    return K.expected_factor_returns(I.summary(series), K.ewma_mean(series, halflife=HALF), t_min=0.2)


@shared
def mus(spark: SparkSession, sf: str) -> DataFrame:
    return K.projected_returns(regions(spark, sf), expected(spark, sf))


@shared
def covariance(spark: SparkSession, sf: str) -> DataFrame:
    return K.stock_covariance(regions(spark, sf), factor_covariance(spark, sf), specific(spark, sf), days=12)


@query("SELECT row, col, round(cov, 9) + 0.0 AS cov FROM fcov")
def ewma_cov(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(factor_covariance(spark, sf), "cov", places=9)


@query("SELECT factor, round(mean, 8) + 0.0 AS mean FROM fmean")
def ewma_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(K.ewma_mean(region_returns(spark, sf), halflife=HALF), "mean", places=8)


@query("SELECT symbol, round(specific_risk, 6) + 0.0 AS specific_risk FROM spec")
def ewma_specific(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(specific(spark, sf), "specific_risk")


@query("SELECT c.row, c.col, round(coalesce(c.cov / nullif(sqrt(a.cov) * sqrt(b.cov), 0), 0), 6) + 0.0 AS corr FROM fcov c JOIN fcov a ON a.row = c.row AND a.col = c.row JOIN fcov b ON b.row = c.col AND b.col = c.col")
def factor_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(K.correlations(factor_covariance(spark, sf)), "corr")


@query("SELECT factor, round(mean, 8) + 0.0 AS mean, round(shrinkage, 6) + 0.0 AS shrinkage, round(mean * shrinkage, 8) + 0.0 AS expected FROM expf")
def expected_factor_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(expected(spark, sf).select("factor", "mean", "shrinkage", "expected"), "mean", "expected", places=8), "shrinkage")


@query("SELECT symbol, round(mu, 8) + 0.0 AS mu FROM mus")
def expected_stock_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(mus(spark, sf), "mu", places=8)


@query("SELECT row, col, round(cov, 9) + 0.0 AS cov FROM scov")
def stock_covariance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(covariance(spark, sf), "cov", places=9)


# two segments, by the last month's market value
CTE |= {
    "seg": "SELECT symbol, CASE WHEN row_number() OVER (ORDER BY market_cap DESC, symbol) <= 10 THEN 'top' ELSE 'rest' END AS segment FROM caps WHERE date = (SELECT max(date) FROM caps) AND market_cap > 0",
    "sfret": "SELECT date, factor || '__' || segment AS factor, sum(x * ret) / sum(x) AS ret FROM rets JOIN xlong USING (symbol) JOIN seg USING (symbol) WHERE ret IS NOT NULL GROUP BY ALL",
    "sfc": "SELECT * FROM sfret WHERE date IN (SELECT date FROM sfret GROUP BY date HAVING count(DISTINCT split_part(factor, '__', 2)) = 2)",
}


@shared
def segments(spark: SparkSession, sf: str) -> DataFrame:
    from quantloom.operators.panel import latest

    last = X.top_flag(latest(capped(spark, sf), ["market_cap"]).where("market_cap > 0"), n=10, out="flag")
    return last.select("symbol", F.when(F.col("flag") == 1, "top").otherwise("rest").alias("segment"))


def segment_returns(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    rows = B.panel(spark, sf).where("ret IS NOT NULL").join(F.broadcast(regions(spark, sf)), "symbol").join(F.broadcast(segments(spark, sf)), "symbol")
    series = rows.groupBy("segment", "date", "factor").agg((F.sum(F.col("x") * F.col("ret")) / F.sum("x")).alias("ret"))
    return {s: series.where(F.col("segment") == s).select("date", "factor", "ret") for s in ("top", "rest")}


@query("SELECT symbol, segment FROM seg")
def segment_slice(spark: SparkSession, sf: str) -> DataFrame:
    return segments(spark, sf)


@query("SELECT date, factor, round(ret, 6) + 0.0 AS ret FROM sfc")
def joint_factor_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(PF.joint_factor_returns(segment_returns(spark, sf)), "ret")


@query(f"""SELECT row, col, round(s / sw * sw * sw / (sw * sw - sww), 9) + 0.0 AS cov FROM (SELECT row, col, sum(w) AS sw, sum(w * w) AS sww, sum(w * (x - mx) * (y - my)) AS s FROM (
    SELECT a.factor AS row, b.factor AS col, a.w, a.ret AS x, b.ret AS y, sum(a.w * a.ret) OVER g / sum(a.w) OVER g AS mx, sum(a.w * b.ret) OVER g / sum(a.w) OVER g AS my
    FROM (SELECT s.*, pow(0.5, age / {HALF}) AS w FROM sfc s JOIN (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS age FROM (SELECT DISTINCT date FROM sfc)) USING (date)) a JOIN sfc b ON a.date = b.date WINDOW g AS (PARTITION BY a.factor, b.factor)) GROUP BY row, col)""")
def joint_cov(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(K.ewma_covariance(PF.joint_factor_returns(segment_returns(spark, sf)), halflife=HALF), "cov", places=9)


@query("SELECT symbol, " + ", ".join(f"round(CASE WHEN segment = '{s}' THEN {c} ELSE 0 END, 6) + 0.0 AS {c}__{s}" for s in ("top", "rest") for c in B.REGION_COLUMNS) + " FROM shares_by_region JOIN seg USING (symbol)")
def joint_exposures(spark: SparkSession, sf: str) -> DataFrame:
    rows = B.industries(spark, sf).join(F.broadcast(segments(spark, sf)), "symbol")
    out = PF.joint_exposures(rows, B.REGION_COLUMNS, ["top", "rest"]).drop("segment")
    return rounded(out, *PF.joint_columns(B.REGION_COLUMNS, ["top", "rest"]))

