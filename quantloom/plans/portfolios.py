"""Queries of portfolios, backtests, timing, checks and plot tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.solver import Limits, frontier, maximum_return, minimum_variance
from quantloom.operators import backtest as T
from quantloom.operators import factors as X
from quantloom.operators import inference as I
from quantloom.operators import panel as P
from quantloom.operators import portfolio as PF
from quantloom.operators import risk as K
from quantloom.operators import timing as M
from quantloom.operators import validation as V
from quantloom.plans import base as B
from quantloom.plans import models as MD
from quantloom.plans.base import CTE, query, r6, rounded, shared
from quantloom.plans.factors import capped
from quantloom.plans.models import nw_sql, slope_sql

CTE |= {
    "weights": "SELECT 'Equal-Weight' AS portfolio, symbol, 1.0 / count(*) OVER () AS weight FROM spec UNION ALL SELECT 'Inverse-Variance', symbol, (1 / pow(specific_risk, 2)) / sum(1 / pow(specific_risk, 2)) OVER () FROM spec",
    "pexp": "SELECT portfolio, factor, sum(weight * x) AS exposure FROM weights JOIN xlong USING (symbol) GROUP BY ALL",
    "prisk": "SELECT portfolio, fv AS factor_var, sv AS specific_var FROM (SELECT a.portfolio, sum(a.exposure * c.cov * b.exposure) AS fv FROM pexp a JOIN fcov c ON a.factor = c.row JOIN pexp b ON b.factor = c.col AND b.portfolio = a.portfolio GROUP BY a.portfolio) JOIN (SELECT portfolio, sum(weight * weight * specific_risk * specific_risk) / 12 AS sv FROM weights JOIN spec USING (symbol) GROUP BY portfolio) USING (portfolio)",
    "pconc": "SELECT portfolio, CAST(sum(CASE WHEN a > 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS n_holdings, sum(weight * weight) AS hhi, sum(CASE WHEN r <= 1 THEN a ELSE 0 END) AS top1, sum(CASE WHEN r <= 5 THEN a ELSE 0 END) AS top5, sum(CASE WHEN r <= 10 THEN a ELSE 0 END) AS top10 FROM (SELECT *, abs(weight) AS a, row_number() OVER (PARTITION BY portfolio ORDER BY abs(weight) DESC, symbol) AS r FROM weights) GROUP BY portfolio",
    "pret": "SELECT portfolio, date, sum(weight * coalesce(ret, 0)) AS ret FROM rets JOIN weights USING (symbol) GROUP BY ALL",
    "pdraw": "SELECT *, cumulative / max(cumulative) OVER (PARTITION BY portfolio ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS drawdown FROM (SELECT *, product(1 + ret) OVER (PARTITION BY portfolio ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative FROM pret)",
}


@shared
def weights(spark: SparkSession, sf: str) -> DataFrame:
    risk = MD.specific(spark, sf)
    variances = risk.select("symbol", (F.col("specific_risk") * F.col("specific_risk")).alias("variance"))
    return PF.equal_weights(risk).unionByName(PF.inverse_variance_weights(variances))


@query("SELECT portfolio, symbol, round(weight, 6) + 0.0 AS weight FROM weights")
def simple_portfolios(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(weights(spark, sf), "weight")


@query("SELECT portfolio, factor, round(exposure, 6) + 0.0 AS exposure FROM pexp")
def portfolio_factor_exposure(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(PF.factor_exposure(weights(spark, sf), MD.regions(spark, sf)), "exposure")


@query("SELECT portfolio, round(1e4 * factor_var, 5) + 0.0 AS factor_var, round(1e4 * specific_var, 5) + 0.0 AS specific_var, round(factor_var / (factor_var + specific_var), 6) + 0.0 AS factor_pct, round(specific_var / (factor_var + specific_var), 6) + 0.0 AS specific_pct, round(sqrt((factor_var + specific_var) * 12), 6) + 0.0 AS ann_vol FROM prisk")
def risk_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    out = PF.risk_decomposition(weights(spark, sf), MD.regions(spark, sf), MD.factor_covariance(spark, sf), MD.specific(spark, sf), days=12)
    out = out.withColumns({c: 1e4 * F.col(c) for c in ("factor_var", "specific_var")})
    return rounded(rounded(out, "factor_var", "specific_var", places=5), "factor_pct", "specific_pct", "ann_vol")


@query("SELECT portfolio, n_holdings, round(hhi, 6) + 0.0 AS hhi, round(1 / hhi, 5) + 0.0 AS effective_n, round(top1, 6) + 0.0 AS top1, round(top5, 6) + 0.0 AS top5, round(top10, 6) + 0.0 AS top10 FROM pconc")
def concentration(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(rounded(PF.concentration(weights(spark, sf)), "hhi", "top1", "top5", "top10"), "effective_n", places=5)


@query("SELECT portfolio, symbol, CAST(row_number() OVER (PARTITION BY portfolio ORDER BY abs(weight) DESC, symbol) AS INTEGER) AS rank, round(weight, 6) + 0.0 AS weight FROM weights WHERE portfolio = 'Inverse-Variance' QUALIFY rank <= 5")
def top_holdings(spark: SparkSession, sf: str) -> DataFrame:
    out = PF.top_holdings(weights(spark, sf).where("portfolio = 'Inverse-Variance'"), 5)
    return rounded(out.select("portfolio", "symbol", "rank", "weight"), "weight")


@query("SELECT portfolio, factor, round(exposure, 6) + 0.0 AS weight FROM pexp")
def sector_weights(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(PF.sector_weights(weights(spark, sf), MD.regions(spark, sf)), "weight")


@query("SELECT portfolio, round(m * 12, 6) + 0.0 AS ann_return, round(sqrt((factor_var + specific_var) * 12), 6) + 0.0 AS ann_vol, round(factor_var / (factor_var + specific_var), 6) + 0.0 AS factor_pct, n_holdings, round(hhi, 6) + 0.0 AS hhi, round(top5, 6) + 0.0 AS top5 FROM prisk JOIN pconc USING (portfolio) JOIN (SELECT portfolio, sum(weight * mu) AS m FROM weights JOIN mus USING (symbol) GROUP BY portfolio) USING (portfolio)")
def portfolio_comparison(spark: SparkSession, sf: str) -> DataFrame:
    w = weights(spark, sf)
    risk = PF.risk_decomposition(w, MD.regions(spark, sf), MD.factor_covariance(spark, sf), MD.specific(spark, sf), days=12)
    out = PF.comparison(risk, PF.concentration(w), MD.mus(spark, sf), w, days=12)
    return rounded(out.select("portfolio", "ann_return", "ann_vol", "factor_pct", "n_holdings", "hhi", "top5"), "ann_return", "ann_vol", "factor_pct", "hhi", "top5")


@shared
def series(spark: SparkSession, sf: str) -> DataFrame:
    return PF.return_series(weights(spark, sf), B.panel(spark, sf).select("date", "symbol", "ret"))


@query("SELECT portfolio, date, round(ret, 6) + 0.0 AS ret FROM pret")
def portfolio_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(series(spark, sf), "ret")


@query("SELECT portfolio, date, round(cumulative, 6) + 0.0 AS cumulative, round(drawdown, 6) + 0.0 AS drawdown FROM pdraw")
def drawdowns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(PF.drawdowns(series(spark, sf)).select("portfolio", "date", "cumulative", "drawdown"), "cumulative", "drawdown")


@query("SELECT portfolio, n, round(tr, 6) + 0.0 AS total_return, round(ar, 6) + 0.0 AS ann_return, round(vol, 6) + 0.0 AS ann_vol, round(ar / nullif(vol, 0), 5) + 0.0 AS sharpe, round(dd, 6) + 0.0 AS max_drawdown, round(CASE WHEN dd < 0 THEN ar / abs(dd) END, 5) + 0.0 AS calmar FROM (SELECT *, pow(1 + tr, 12.0 / n) - 1 AS ar FROM (SELECT portfolio, count(*) AS n, product(1 + ret) - 1 AS tr, stddev_samp(ret) * sqrt(12) AS vol, min(drawdown) AS dd FROM pdraw GROUP BY portfolio))")
def performance_metrics(spark: SparkSession, sf: str) -> DataFrame:
    out = PF.performance(series(spark, sf), days=12)
    return rounded(rounded(out, "total_return", "ann_return", "ann_vol", "max_drawdown"), "sharpe", "calmar", places=5)


@query("""SELECT portfolio, n, round(beta, 6) + 0.0 AS beta, round(te, 6) + 0.0 AS tracking_error, round(corr, 6) + 0.0 AS correlation, round(up, 6) + 0.0 AS up_capture, round(down, 6) + 0.0 AS down_capture, round(m - beta * b, 6) + 0.0 AS alpha, round(act / nullif(te, 0), 5) + 0.0 AS information_ratio FROM (
    SELECT portfolio, count(*) AS n, covar_samp(ret, market_ret) / var_samp(market_ret) AS beta, stddev_samp(ret - market_ret) * sqrt(12) AS te, corr(ret, market_ret) AS corr, avg(ret) FILTER (market_ret > 0) / avg(market_ret) FILTER (market_ret > 0) AS up, avg(ret) FILTER (market_ret < 0) / avg(market_ret) FILTER (market_ret < 0) AS down, avg(ret) * 12 AS m, avg(market_ret) * 12 AS b, avg(ret - market_ret) * 12 AS act
    FROM pret JOIN mkt USING (date) WHERE market_ret IS NOT NULL GROUP BY portfolio)""")
def benchmark_relative(spark: SparkSession, sf: str) -> DataFrame:
    bench = B.market(spark, sf).select("date", F.col("market_ret").alias("bench"))
    out = PF.benchmark_relative(series(spark, sf), bench, days=12)
    return rounded(rounded(out, "beta", "tracking_error", "correlation", "up_capture", "down_capture", "alpha"), "information_ratio", places=5)


# ---- optimization ----------------------------------------------------------------------------------------------


def problem(spark: SparkSession, sf: str) -> DataFrame:
    return PF.problem_rows(MD.covariance(spark, sf), MD.mus(spark, sf))


@query("SELECT symbol, round((1 / pow(specific_risk, 2)) / sum(1 / pow(specific_risk, 2)) OVER (), 5) + 0.0 AS weight FROM spec")
def gmv_diagonal(spark: SparkSession, sf: str) -> DataFrame:
    """The solver on a diagonal covariance, where least variance has a closed form."""
    risk = MD.specific(spark, sf)
    diagonal = risk.select(F.col("symbol").alias("row"), F.col("symbol").alias("col"), (F.col("specific_risk") * F.col("specific_risk")).alias("cov"))
    rows = PF.problem_rows(diagonal, risk.select("symbol", F.lit(0.0).alias("mu")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        symbols, sigma, _ = PF.dense(pdf)
        return pd.DataFrame({"symbol": symbols, "weight": minimum_variance(sigma)[0]})

    return rounded(rows.groupBy("problem").applyInPandas(solve, "symbol string, weight double"), "weight", places=5)


@query()
def efficient_frontier(spark: SparkSession, sf: str) -> DataFrame:
    points = PF.frontiers(problem(spark, sf))
    return rounded(points.select("problem", "point", "expected_return", "volatility", "sharpe", "converged").distinct(), "expected_return", "volatility", "sharpe")


@query()
def max_sharpe(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(PF.max_sharpe(PF.frontiers(problem(spark, sf))).select("point", "symbol", "weight"), "weight", places=5)


def _solved(rows: DataFrame, limits, points: int | None = None) -> DataFrame:
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        symbols, sigma, mu = PF.dense(pdf)
        if points:
            path = [p for p in frontier(sigma, mu, points, limits(symbols, sigma, mu)) if p["converged"]]
            w = max(path, key=lambda p: p["sharpe"] or -np.inf)["weights"] if path else np.full(len(symbols), np.nan)
        else:
            w, ok = minimum_variance(sigma, limits(symbols, sigma, mu))
            w = w if ok else np.full(len(symbols), np.nan)
        return pd.DataFrame({"symbol": symbols, "weight": w})

    return rounded(rows.groupBy("problem").applyInPandas(solve, "symbol string, weight double"), "weight", places=5)


@query()
def long_short(spark: SparkSession, sf: str) -> DataFrame:
    return _solved(problem(spark, sf), lambda s, c, m: Limits(cap=0.1, soft=True, leverage=1.2), 8)


CTE["betas"] = "SELECT symbol, covar_samp(ret, market_ret) / var_samp(market_ret) AS beta FROM rets JOIN mkt USING (date) WHERE ret IS NOT NULL AND market_ret IS NOT NULL GROUP BY symbol"
#: The conditions of least variance with weights that sum to one and have no beta, as equations.
_NEUTRAL = f"""WITH RECURSIVE b AS (SELECT symbol, beta, row_number() OVER (ORDER BY symbol) AS i, count(*) OVER () AS n FROM betas JOIN spec USING (symbol)),
    cells AS (SELECT 1 AS one, x.i, y.i AS j, s.cov AS v FROM scov s JOIN b x ON x.symbol = s.row JOIN b y ON y.symbol = s.col UNION ALL
      SELECT 1, i, n + 1, 1.0 FROM b UNION ALL SELECT 1, n + 1, i, 1.0 FROM b UNION ALL SELECT 1, i, n + 2, beta FROM b UNION ALL SELECT 1, n + 2, i, beta FROM b UNION ALL
      SELECT 1, n + k.k, n + l.k, 0.0 FROM (SELECT any_value(n) AS n FROM b), range(1, 3) k(k), range(1, 3) l(k) UNION ALL
      SELECT 1, i.i, n + 3, CASE WHEN i.i = n + 1 THEN 1.0 ELSE 0.0 END FROM (SELECT any_value(n) AS n FROM b), range(1, 200) i(i) WHERE i.i <= n + 2),
    size AS (SELECT max(i) AS size FROM cells),
    {MD.solved_sql("w", "cells", "one", "(SELECT size FROM size)")}, neutral AS (SELECT symbol, beta, v AS weight FROM w JOIN b ON b.i = w.i)"""


def betas(spark: SparkSession, sf: str) -> DataFrame:
    """(symbol, beta) against the market, over all dates."""
    both = B.panel(spark, sf).join(F.broadcast(B.market(spark, sf).select("date", "market_ret")), "date").where("ret IS NOT NULL AND market_ret IS NOT NULL")
    return both.groupBy("symbol").agg((F.covar_samp("ret", "market_ret") / F.var_samp("market_ret")).alias("beta"))


@shared
def neutral_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = problem(spark, sf).join(F.broadcast(betas(spark, sf)), "symbol")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        symbols, sigma, _ = PF.dense(pdf)
        beta = pdf.set_index("symbol").loc[symbols, "beta"].to_numpy(float)
        w, ok = minimum_variance(sigma, Limits(neutral=beta[:, None], leverage=50.0))
        return pd.DataFrame({"symbol": symbols, "weight": w if ok else np.nan})

    return rows.groupBy("problem").applyInPandas(solve, "symbol string, weight double")


@query(f"{_NEUTRAL} SELECT symbol, round(weight, 4) + 0.0 AS weight FROM neutral")
def beta_neutral(spark: SparkSession, sf: str) -> DataFrame:
    """Least variance, long and short, without exposure to the market."""
    return rounded(neutral_weights(spark, sf), "weight", places=4)


@query("SELECT 'Beta-Neutral' AS portfolio, 0.0 AS beta, 'PASS' AS verdict UNION ALL SELECT portfolio, round(sum(weight * beta), 5) + 0.0, CASE WHEN abs(sum(weight * beta)) <= 1e-6 THEN 'PASS' ELSE 'FAIL' END FROM weights JOIN betas USING (symbol) GROUP BY portfolio")
def beta_neutrality_check(spark: SparkSession, sf: str) -> DataFrame:
    """The neutral portfolio has no beta; portfolios that do not ask for that have one."""
    w = weights(spark, sf).unionByName(neutral_weights(spark, sf).select(F.lit("Beta-Neutral").alias("portfolio"), "symbol", "weight"))
    return rounded(V.beta_neutrality(w, betas(spark, sf)), "beta", places=5)


@query("SELECT symbol, CASE WHEN row_number() OVER (ORDER BY mu DESC) <= 10 THEN 0.1 ELSE 0.0 END::DOUBLE AS weight FROM mus")
def max_return_capped(spark: SparkSession, sf: str) -> DataFrame:
    """The greatest return under a cap of a tenth: the ten best names."""
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("symbol")
        w, ok = maximum_return(pdf["mu"].to_numpy(float), Limits(cap=0.1))
        return pd.DataFrame({"symbol": pdf["symbol"], "weight": w if ok else np.nan})

    rows = MD.mus(spark, sf).withColumn("problem", F.lit("all"))
    return rounded(rows.groupBy("problem").applyInPandas(solve, "symbol string, weight double"), "weight", places=4)


@query("SELECT round(1e6 * min(specific_risk * specific_risk), 4) + 0.0 AS least, min(specific_risk) > 0 AS positive FROM spec")
def psd_check(spark: SparkSession, sf: str) -> DataFrame:
    """The least eigenvalue of a diagonal covariance is its least variance."""
    risk = MD.specific(spark, sf).select("symbol", (F.col("specific_risk") * F.col("specific_risk")).alias("v"))
    other = risk.select(F.col("symbol").alias("col"), F.lit(0.0).alias("z"))
    full = risk.join(other, F.lit(True)).select(F.col("symbol").alias("row"), "col", F.when(F.col("symbol") == F.col("col"), F.col("v")).otherwise(F.col("z")).alias("cov"))
    least = V.smallest_eigenvalue(full)
    return spark.range(1).select(F.lit(round(1e6 * least, 4)).alias("least"), F.lit(least >= -1e-8).alias("positive"))


@query()
def group_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Brands of the first decade together are held near the cap by a soft limit."""
    return _solved(problem(spark, sf), lambda s, c, m: Limits(cap=0.15, soft_group=np.array([x.startswith("Brand#1") for x in s], float), soft_group_cap=0.2, soft_group_penalty=0.01))


@query()
def industry_capped(spark: SparkSession, sf: str) -> DataFrame:
    """Hard caps on regions (by each brand's largest), and hard caps on brands."""
    largest = MD.regions(spark, sf).groupBy("symbol").agg(F.max_by("factor", "x").alias("region"))
    rows = problem(spark, sf).join(largest, "symbol")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        symbols, sigma, _ = PF.dense(pdf)
        region = pdf.set_index("symbol").loc[symbols, "region"]
        groups = np.stack([(region == r).to_numpy(float) for r in sorted(set(region))], axis=1)
        w, ok = minimum_variance(sigma, Limits(cap=0.1, groups=groups, group_cap=max(0.3, 1.2 / groups.shape[1])))
        return pd.DataFrame({"symbol": symbols, "weight": w if ok else np.nan})

    return rounded(rows.groupBy("problem").applyInPandas(solve, "symbol string, weight double"), "weight", places=5)


# ---- backtests -------------------------------------------------------------------------------------------------

START = "1999-01-01"
CTE |= {
    "rebal": f"SELECT date AS as_of, lead(date) OVER (ORDER BY date) AS until FROM (SELECT max(date) AS date FROM (SELECT DISTINCT date FROM px) GROUP BY date_trunc('month', date)) WHERE date >= DATE '{START}' - INTERVAL 1 MONTH",
    "bw": "SELECT 'Momentum' AS portfolio, as_of, symbol, 1.0 / count(*) OVER (PARTITION BY as_of) AS weight FROM (SELECT b.as_of, r.symbol, row_number() OVER (PARTITION BY b.as_of ORDER BY r.ret DESC, r.symbol) AS k FROM rebal b JOIN rets r ON r.date = b.as_of WHERE r.ret IS NOT NULL) WHERE k <= 5 UNION ALL SELECT 'Equal-Weight', as_of, symbol, 1.0 / count(*) OVER (PARTITION BY as_of) FROM rebal CROSS JOIN (SELECT DISTINCT symbol FROM px)",
}


def rebalances(spark: SparkSession, sf: str) -> DataFrame:
    return T.rebalance_dates(P.calendar(B.prices(spark, sf)), START)


def backtest_weights(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    panel, dates = B.panel(spark, sf), rebalances(spark, sf)
    rank = F.row_number().over(Window.partitionBy("as_of").orderBy(F.desc("ret"), "symbol"))
    best = panel.join(F.broadcast(dates.select(F.col("as_of").alias("date"), "as_of")), "date").where("ret IS NOT NULL").withColumn("k", rank).where("k <= 5")
    equal = F.lit(1.0) / F.count("*").over(Window.partitionBy("as_of"))
    first = best.select(F.lit("Momentum").alias("portfolio"), "as_of", "symbol", equal.alias("weight"))
    everything = panel.select("symbol").distinct().crossJoin(F.broadcast(dates.select("as_of")))
    return first.unionByName(everything.select(F.lit("Equal-Weight").alias("portfolio"), "as_of", "symbol", equal.alias("weight")))


@query("SELECT as_of, until FROM rebal")
def rebalance_dates(spark: SparkSession, sf: str) -> DataFrame:
    return rebalances(spark, sf)


@query("SELECT portfolio, r.date, round(sum(weight * coalesce(ret, 0)), 6) + 0.0 AS ret FROM rets r JOIN rebal b ON r.date > b.as_of AND (b.until IS NULL OR r.date <= b.until) JOIN bw ON bw.as_of = b.as_of AND bw.symbol = r.symbol GROUP BY ALL")
def backtest_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.held_returns(backtest_weights(spark, sf), rebalances(spark, sf), B.panel(spark, sf).select("date", "symbol", "ret")), "ret")


@query("""SELECT portfolio, as_of, round(sum(abs(d)) / 2, 6) + 0.0 AS turnover FROM (SELECT portfolio, as_of, symbol, sum(w) AS d FROM (
    SELECT b.portfolio, b.as_of, b.symbol, b.weight AS w FROM bw b WHERE b.as_of > (SELECT min(as_of) FROM rebal) UNION ALL SELECT b.portfolio, r.until, b.symbol, -b.weight FROM bw b JOIN rebal r USING (as_of) WHERE r.until IS NOT NULL) GROUP BY ALL) GROUP BY ALL""")
def backtest_turnover(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.turnover(backtest_weights(spark, sf)), "turnover")


MODEL_START = "2000-07-01"
_RUN = "(SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM {0}))"
_KEYED = "(SELECT as_of || '|' || factor AS k, date, ret FROM baged)"
CTE |= {
    "mrebal": f"SELECT date AS as_of, lead(date) OVER (ORDER BY date) AS until FROM (SELECT max(date) AS date FROM (SELECT DISTINCT date FROM px) GROUP BY date_trunc('month', date)) WHERE date >= DATE '{MODEL_START}' - INTERVAL 1 MONTH",
    "bspec": f"""SELECT as_of, symbol, sqrt(s / sw * sw * sw / (sw * sw - sww) * 12) AS specific_risk FROM (SELECT as_of, symbol, sum(w) AS sw, sum(w * w) AS sww, sum(w * (residual - m) * (residual - m)) AS s FROM (
        SELECT *, sum(w * residual) OVER g / sum(w) OVER g AS m FROM (SELECT as_of, symbol, residual, pow(2.0, i / {MD.HALF}) AS w FROM resid JOIN {_RUN.format("resid")} USING (date) JOIN mrebal ON date <= as_of) WINDOW g AS (PARTITION BY as_of, symbol)) GROUP BY ALL)""",
    "baged": f"SELECT as_of, date, factor, ret, pow(2.0, i / {MD.HALF}) AS w FROM fret JOIN {_RUN.format('fret')} USING (date) JOIN mrebal ON date <= as_of",
    "bcov": """SELECT as_of, row, col, s / sw * sw * sw / (sw * sw - sww) AS cov FROM (SELECT as_of, row, col, sum(w) AS sw, sum(w * w) AS sww, sum(w * (x - mx) * (y - my)) AS s FROM (
        SELECT a.as_of, a.factor AS row, b.factor AS col, a.w, a.ret AS x, b.ret AS y, sum(a.w * a.ret) OVER g / sum(a.w) OVER g AS mx, sum(a.w * b.ret) OVER g / sum(a.w) OVER g AS my FROM baged a JOIN baged b ON a.as_of = b.as_of AND a.date = b.date WINDOW g AS (PARTITION BY a.as_of, a.factor, b.factor)) GROUP BY ALL)""",
    "bexp": f"SELECT m.as_of, m.factor, m.mean * least(greatest((abs(nw_t) - 0.2) / (3.0 - 0.2), 0.0), 1.0) AS expected FROM (SELECT as_of, factor, as_of || '|' || factor AS k, sum(w * ret) / sum(w) AS mean FROM baged GROUP BY ALL) m JOIN {nw_sql(_KEYED, 'k')} t USING (k)",
    "eqheld": "SELECT b.as_of, b.until, s.symbol, 1.0 / count(*) OVER (PARTITION BY b.as_of) AS weight FROM mrebal b JOIN bspec s USING (as_of) JOIN rets r ON r.date = b.as_of AND r.symbol = s.symbol WHERE r.ret IS NOT NULL",
}


def model_dates(spark: SparkSession, sf: str) -> DataFrame:
    return T.rebalance_dates(P.calendar(B.prices(spark, sf)), MODEL_START)


def held_exposures(spark: SparkSession, sf: str) -> DataFrame:
    """(date, symbol, regions..., segment): a brand's regions on dates with a return, and its segment of that date."""
    rows = X.top_flag(capped(spark, sf), n=10, out="flag").where("ret IS NOT NULL").join(F.broadcast(B.industries(spark, sf)), "symbol")
    return rows.select("date", "symbol", *B.REGION_COLUMNS, F.when(F.col("flag") == 1, "top").when(F.col("flag") == 0, "rest").alias("segment"))


@shared
def model_problems(spark: SparkSession, sf: str) -> DataFrame:
    dates = model_dates(spark, sf)
    cov, expected = T.factor_models(MD.region_returns(spark, sf), dates, MD.HALF, t_min=0.2)
    risk = T.specific_as_of(MD.region_residuals(spark, sf), dates, MD.HALF, days=12)
    x = T.latest_as_of(held_exposures(spark, sf), dates, B.REGION_COLUMNS)
    return T.problems(x, B.REGION_COLUMNS, cov, expected, risk, days=12)


@query("SELECT as_of, symbol, round(specific_risk, 6) + 0.0 AS specific_risk FROM bspec")
def walk_forward_specific(spark: SparkSession, sf: str) -> DataFrame:
    """Specific risks as of each rebalance, from running sums along each brand."""
    return rounded(T.specific_as_of(MD.region_residuals(spark, sf), model_dates(spark, sf), MD.HALF, days=12), "specific_risk")


@query("SELECT as_of, row, col, round(cov, 9) + 0.0 AS cov FROM bcov")
def walk_forward_covariance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.factor_models(MD.region_returns(spark, sf), model_dates(spark, sf), MD.HALF, t_min=0.2)[0], "cov", places=9)


@query("SELECT as_of, factor, round(expected, 8) + 0.0 AS expected FROM bexp")
def walk_forward_expected(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(T.factor_models(MD.region_returns(spark, sf), model_dates(spark, sf), MD.HALF, t_min=0.2)[1], "expected", places=8)


@query("SELECT as_of, r.symbol, round((1 / pow(specific_risk, 2)) / sum(1 / pow(specific_risk, 2)) OVER (PARTITION BY as_of), 5) + 0.0 AS weight FROM bspec s JOIN rets r ON r.date = s.as_of AND r.symbol = s.symbol WHERE r.ret IS NOT NULL")
def walk_forward_diagonal(spark: SparkSession, sf: str) -> DataFrame:
    """The whole walk-forward with factors that never move: each rebalance's least variance has a closed form."""
    dates = model_dates(spark, sf)
    still = MD.region_returns(spark, sf).withColumn("ret", F.lit(0.0))
    cov, expected = T.factor_models(still, dates, MD.HALF)
    risk = T.specific_as_of(MD.region_residuals(spark, sf), dates, MD.HALF, days=12)
    rows = T.problems(T.latest_as_of(held_exposures(spark, sf), dates, B.REGION_COLUMNS), B.REGION_COLUMNS, cov, expected, risk, days=12)
    out = T.walk_forward(rows, 1, lambda pdf: Limits()).where("portfolio = 'GMV'")
    return rounded(out.select("as_of", "symbol", "weight"), "weight", places=5)


@shared
def model_weights(spark: SparkSession, sf: str) -> DataFrame:
    return T.walk_forward(model_problems(spark, sf))


@query()
def walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(model_weights(spark, sf), "weight", places=5)


@query("SELECT r.date, round(sum(weight * coalesce(ret, 0)), 6) + 0.0 AS ret FROM eqheld e JOIN rets r ON r.symbol = e.symbol AND r.date > e.as_of AND (e.until IS NULL OR r.date <= e.until) GROUP BY r.date")
def walk_forward_equal_returns(spark: SparkSession, sf: str) -> DataFrame:
    """The returns of the equal portfolio of the walk-forward's own brands."""
    equal = model_weights(spark, sf).where("portfolio = 'Equal-Weight'")
    return rounded(T.held_returns(equal, model_dates(spark, sf), B.panel(spark, sf).select("date", "symbol", "ret")).select("date", "ret"), "ret")


@query()
def walk_forward_performance(spark: SparkSession, sf: str) -> DataFrame:
    """The walk-forward weights held to the next rebalance, with their turnover."""
    w = model_weights(spark, sf)
    panel = B.panel(spark, sf).select("date", "symbol", "ret")
    return rounded(PF.performance(T.held_returns(w, model_dates(spark, sf), panel), days=12, turnover=T.turnover(w)), "total_return", "ann_return", "ann_vol", "sharpe", "max_drawdown", "calmar", "avg_turnover", places=4)


def _segment_limits(pdf: pd.DataFrame) -> Limits:
    rest = (pdf["segment"] == "rest").to_numpy(float)
    return Limits(cap=np.where(rest > 0, 0.05, 0.15), soft=True, soft_group=rest, soft_group_cap=0.2, soft_group_penalty=0.01)


@query()
def segmented_walk_forward(spark: SparkSession, sf: str) -> DataFrame:
    """The joint model of two segments: who is in which is asked anew at each rebalance; caps differ by segment, and the
    rest as a group has a soft cap."""
    names, rows = ["top", "rest"], held_exposures(spark, sf).where("segment IS NOT NULL")
    long = rows.select("date", "symbol", "segment", F.explode(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).alias("x")) for c in B.REGION_COLUMNS])).alias("f")).select("date", "symbol", "segment", "f.factor", "f.x")
    moved = long.join(B.panel(spark, sf).select("date", "symbol", "ret"), ["date", "symbol"])
    returns = moved.groupBy("date", "segment", "factor").agg((F.sum(F.col("x") * F.col("ret")) / F.sum("x")).alias("f_ret"))
    left = moved.join(F.broadcast(returns), ["date", "segment", "factor"]).groupBy("date", "symbol", "segment").agg((F.first("ret") - F.sum(F.col("x") * F.col("f_ret"))).alias("residual"))
    series = {s: returns.where(F.col("segment") == s).select("date", "factor", F.col("f_ret").alias("ret")) for s in names}
    residuals = {s: left.where(F.col("segment") == s) for s in names}
    problems = T.joint_problems(rows, B.REGION_COLUMNS, series, residuals, model_dates(spark, sf), MD.HALF, days=12, t_min=0.2)
    return rounded(T.walk_forward(problems, limits=_segment_limits), "weight", places=5)


# ---- timing ----------------------------------------------------------------------------------------------------

CTE |= {
    "tpx": "SELECT name, date, price, ret FROM (SELECT factor AS name, date, ret, product(1 + ret) OVER (PARTITION BY factor ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price FROM fret)",
    "smas": "SELECT *, CASE WHEN sma IS NULL THEN NULL WHEN price >= sma THEN 1.0 ELSE -1.0 END AS position FROM (SELECT *, CASE WHEN count(price) OVER w >= 6 THEN avg(price) OVER w END AS sma FROM tpx WINDOW w AS (PARTITION BY name ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))",
}


@shared
def indexes(spark: SparkSession, sf: str) -> DataFrame:
    return M.price_index(MD.region_returns(spark, sf).select(F.col("factor").alias("name"), "date", "ret"))


@query("SELECT name, date, round(price, 6) + 0.0 AS price FROM tpx")
def factor_index(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(indexes(spark, sf).select("name", "date", "price"), "price")


@query("""WITH RECURSIVE t AS (SELECT name, date, price, row_number() OVER (PARTITION BY name ORDER BY date) AS i FROM tpx),
    e AS (SELECT name, date, i, price AS a, price AS b, CAST(0.0 AS DOUBLE) AS m, CAST(0.0 AS DOUBLE) AS g FROM t WHERE i = 1
      UNION ALL SELECT t.name, t.date, t.i, 2.0 / 13 * t.price + (1 - 2.0 / 13) * e.a, 2.0 / 27 * t.price + (1 - 2.0 / 27) * e.b, (2.0 / 13 * t.price + (1 - 2.0 / 13) * e.a) - (2.0 / 27 * t.price + (1 - 2.0 / 27) * e.b),
        2.0 / 10 * ((2.0 / 13 * t.price + (1 - 2.0 / 13) * e.a) - (2.0 / 27 * t.price + (1 - 2.0 / 27) * e.b)) + (1 - 2.0 / 10) * e.g FROM e JOIN t ON t.name = e.name AND t.i = e.i + 1)
    SELECT name, date, round(m, 6) + 0.0 AS macd, round(g, 6) + 0.0 AS signal FROM e""")
def macd(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.macd(indexes(spark, sf)).select("name", "date", "macd", "signal"), "macd", "signal")


@query("SELECT name, date, round(sma, 6) + 0.0 AS sma, CAST(position AS DOUBLE) AS position FROM smas")
def sma_cross(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.sma_cross(indexes(spark, sf), n=6).select("name", "date", "sma", "position"), "sma")


@query("SELECT name, date, CAST(CASE WHEN t IS NULL THEN NULL WHEN t >= 0 THEN 1.0 ELSE -1.0 END AS DOUBLE) AS position FROM (SELECT name, date, lag(price, 1) OVER w / nullif(lag(price, 13) OVER w, 0) - 1 AS t FROM tpx WINDOW w AS (PARTITION BY name ORDER BY date))")
def ts_momentum(spark: SparkSession, sf: str) -> DataFrame:
    return M.series_momentum(indexes(spark, sf), lookback=12, skip=1).select("name", "date", "position")


CTE["timed"] = "SELECT * FROM (SELECT name, date, ret, lag(position) OVER (PARTITION BY name ORDER BY date) AS pos FROM smas) WHERE pos IS NOT NULL AND ret IS NOT NULL"


@query(f"SELECT name, x.n, round(hold, 6) + 0.0 AS hold_return, round(timed, 6) + 0.0 AS timed_return, round(share, 6) + 0.0 AS pct_long, round(x.mean, 6) + 0.0 AS excess_mean, round(x.nw_t, 5) + 0.0 AS excess_t FROM (SELECT name, avg(ret) * 12 AS hold, avg(pos * ret) * 12 AS timed, avg(CASE WHEN pos > 0 THEN 1.0 ELSE 0.0 END) AS share FROM timed GROUP BY name) JOIN {nw_sql('(SELECT name, date, pos * ret - ret AS ret FROM timed)', 'name')} x USING (name)")
def timing_alpha(spark: SparkSession, sf: str) -> DataFrame:
    rows = indexes(spark, sf)
    out = M.timing_alpha(M.sma_cross(rows, n=6), rows, days=12)
    return rounded(rounded(out.select("name", "n", "hold_return", "timed_return", "pct_long", "excess_mean", "excess_t"), "hold_return", "timed_return", "pct_long", "excess_mean"), "excess_t", places=5)


GROUPS = {"1-URGENT": ["Brand#11", "Brand#12", "Brand#13"], "2-HIGH": ["Brand#21", "Brand#22"], "3-MEDIUM": ["Brand#31"]}
_GROUPS = "(VALUES " + ", ".join(f"('{k}', '{s}')" for k, v in GROUPS.items() if len(v) > 1 for s in v) + ") g(name, symbol)"
CTE |= {
    "mom": "SELECT name, month, CASE WHEN count(change) OVER w >= 3 THEN product(1 + change) OVER w - 1 END AS momentum FROM macro WINDOW w AS (PARTITION BY name ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "spreads": f"SELECT n.name, date, avg(ret) FILTER (g.symbol IS NOT NULL) - avg(ret) FILTER (g.symbol IS NULL) AS ret FROM rets r CROSS JOIN (SELECT DISTINCT name FROM {_GROUPS}) n LEFT JOIN {_GROUPS} ON g.name = n.name AND g.symbol = r.symbol GROUP BY ALL",
    "tiltpairs": "SELECT s.name, s.date, m.momentum AS x, s.ret AS y FROM spreads s JOIN mom m ON m.name = s.name AND s.date = CAST(m.month + INTERVAL 1 MONTH AS DATE) WHERE m.momentum IS NOT NULL AND s.ret IS NOT NULL",
}


@query(f"SELECT symbol, round(1e6 * coalesce(t.tilt, 0), 4) + 0.0 AS tilt FROM (SELECT DISTINCT symbol FROM px) LEFT JOIN (SELECT g.symbol, sum(f.slope * l.now / 21) AS tilt FROM {_GROUPS} JOIN {slope_sql('tiltpairs', 'name')} f USING (name) JOIN (SELECT name, arg_max(momentum, month) AS now FROM mom WHERE momentum IS NOT NULL GROUP BY name) l USING (name) GROUP BY g.symbol) t USING (symbol)")
def macro_tilt(spark: SparkSession, sf: str) -> DataFrame:
    groups = spark.createDataFrame([(k, s) for k, v in GROUPS.items() for s in v], "name string, symbol string")
    out = M.macro_tilt(B.panel(spark, sf).select("date", "symbol", "ret"), groups, MD.macro_prices(spark, sf))
    return out.select("symbol", r6(1e6 * F.col("tilt"), 4).alias("tilt"))


# ---- checks ----------------------------------------------------------------------------------------------------


@query("SELECT n, round(skew, 5) + 0.0 AS skew, round(kurt, 5) + 0.0 AS kurt, round(n / 6.0 * (skew * skew + kurt * kurt / 4), 3) + 0.0 AS jb FROM (SELECT count(*) AS n, avg(pow(residual - m, 3)) / pow(avg(pow(residual - m, 2)), 1.5) AS skew, avg(pow(residual - m, 4)) / pow(avg(pow(residual - m, 2)), 2) - 3 AS kurt FROM (SELECT residual, avg(residual) OVER () AS m FROM resid))")
def jarque_bera(spark: SparkSession, sf: str) -> DataFrame:
    out = V.jarque_bera(MD.region_residuals(spark, sf), "residual")
    return rounded(rounded(out.select("n", "skew", "kurt", "jb"), "skew", "kurt", places=5), "jb", places=3)


@query("SELECT symbol, n, round(n * (n + 2) * (" + " + ".join(f"pow(s{k} / s0, 2) / (n - {k})" for k in range(1, 6)) + "), 5) + 0.0 AS q FROM (SELECT symbol, count(*) AS n, sum(u * u) AS s0, " + ", ".join(f"sum(u * l{k}) AS s{k}" for k in range(1, 6)) + " FROM (SELECT symbol, u, " + ", ".join(f"lag(u, {k}) OVER (PARTITION BY symbol ORDER BY date) AS l{k}" for k in range(1, 6)) + " FROM (SELECT symbol, date, residual - avg(residual) OVER (PARTITION BY symbol) AS u FROM resid)) GROUP BY symbol) WHERE n >= 30")
def ljung_box(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.ljung_box(MD.region_residuals(spark, sf)), "q", places=5)


@query("SELECT count(*) AS n, round(corr(rx, ry), 6) + 0.0 AS rho FROM (SELECT rank() OVER (ORDER BY mu) + (count(*) OVER (PARTITION BY mu) - 1) / 2.0 AS rx, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2.0 AS ry FROM mus JOIN (SELECT symbol, avg(ret) AS m FROM rets WHERE ret IS NOT NULL GROUP BY symbol) USING (symbol))")
def expected_vs_realized(spark: SparkSession, sf: str) -> DataFrame:
    realized = B.panel(spark, sf).where("ret IS NOT NULL").groupBy("symbol").agg(F.avg("ret").alias("m"))
    return rounded(V.spearman(MD.mus(spark, sf).join(realized, "symbol"), "mu", "m"), "rho")


@query("SELECT round(ma, 6) + 0.0 AS mean_a, round(mb, 6) + 0.0 AS mean_b, round((mb - ma) / sqrt(va / na + vb / nb), 5) + 0.0 AS t FROM (SELECT avg(ret) FILTER (d = 1) AS ma, avg(ret) FILTER (d = 10) AS mb, var_samp(ret) FILTER (d = 1) AS va, var_samp(ret) FILTER (d = 10) AS vb, count(ret) FILTER (d = 1) AS na, count(ret) FILTER (d = 10) AS nb FROM (SELECT ret, CASE WHEN n >= 10 THEN greatest(1, ceil(10 * (r - 1) / (n - 1))) END AS d FROM (SELECT *, row_number() OVER (PARTITION BY date, market_cap > 0 ORDER BY market_cap, symbol) AS r, count(market_cap) OVER (PARTITION BY date) AS n FROM caps WHERE market_cap > 0)))")
def decile_spread(spark: SparkSession, sf: str) -> DataFrame:
    out = V.decile_spread(X.size_decile(capped(spark, sf)))
    return rounded(rounded(out.select("mean_a", "mean_b", "t"), "mean_a", "mean_b"), "t", places=5)


CTE["mresid"] = "SELECT date, symbol, ret - market_ret AS residual FROM rets JOIN mkt USING (date) WHERE ret IS NOT NULL AND market_ret IS NOT NULL"


def market_residuals(spark: SparkSession, sf: str) -> DataFrame:
    """Returns beyond the market's: unlike the residuals of a fit they need not cancel out."""
    market = F.broadcast(B.market(spark, sf).select("date", "market_ret"))
    return B.panel(spark, sf).join(market, "date").select("date", "symbol", (F.col("ret") - F.col("market_ret")).alias("residual")).where("residual IS NOT NULL")


@query(f"SELECT 'all' AS segment, n, round(1e4 * mean, 5) + 0.0 AS mean, round(nw_t, 5) + 0.0 AS nw_t, CASE WHEN abs(nw_t) > 2 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM {nw_sql('(SELECT 1 AS k, date, avg(residual) AS ret FROM mresid GROUP BY date)', 'k')}")
def residual_alpha(spark: SparkSession, sf: str) -> DataFrame:
    out = V.residual_alpha(market_residuals(spark, sf))
    return out.select("segment", "n", r6(1e4 * F.col("mean"), 5).alias("mean"), r6("nw_t", 5).alias("nw_t"), "verdict")


@query(f"SELECT segment, n, round(mean, 7) + 0.0 AS mean, round(nw_t, 5) + 0.0 AS nw_t, CASE WHEN abs(nw_t) > 2 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM {nw_sql('(SELECT segment, date, avg(residual) AS ret FROM mresid JOIN seg USING (symbol) GROUP BY ALL)', 'segment')}")
def alpha_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    rows = market_residuals(spark, sf).join(F.broadcast(MD.segments(spark, sf)), "symbol")
    out = V.residual_alpha(rows, ["segment"]).select("segment", "n", "mean", "nw_t", "verdict")
    return rounded(rounded(out, "mean", places=7), "nw_t", places=5)


@query(f"SELECT count(*) AS n, CAST(sum(CASE WHEN abs(nw_t) > 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS n_significant FROM {nw_sql('fret', 'factor')}")
def significant_factors(spark: SparkSession, sf: str) -> DataFrame:
    return V.significant_factors(I.summary(MD.region_returns(spark, sf)), 0.5)


@query("SELECT symbol FROM shares_by_region WHERE abs(" + " + ".join(f"coalesce({c}, 0)" for c in B.REGION_COLUMNS[:4]) + " - 1) > 0.2")
def industry_sum_check(spark: SparkSession, sf: str) -> DataFrame:
    """With one region left out, the weights of some brands miss one by more than the tolerance."""
    return V.industry_sums(B.industries(spark, sf), B.REGION_COLUMNS[:4], 0.2).select("symbol")


@query("SELECT g.symbol, g.date FROM rets g JOIN (SELECT symbol, fiscal_year_end, CAST(fiscal_year_end + INTERVAL 60 DAY AS DATE) AS visible FROM ratios) r ON g.symbol = r.symbol AND g.date >= r.fiscal_year_end AND g.date < r.visible")
def look_ahead_check(spark: SparkSession, sf: str) -> DataFrame:
    """A panel built without the reporting lag is caught on every row that shows a report too early."""
    from quantloom.operators import asof as A
    from quantloom.operators import fundamentals as R

    ratios = R.annual_ratios(B.annual(spark, sf))
    early = A.as_of_join(B.panel(spark, sf).select("date", "symbol"), A.visible_from(ratios, lag_days=0), ["eps"])
    return V.look_ahead(early, A.visible_from(ratios), "eps")


@query("SELECT portfolio, round(sum(weight), 6) + 0.0 AS total, round(min(weight), 6) + 0.0 AS least, round(sum(abs(weight)), 6) + 0.0 AS gross, CASE WHEN abs(sum(weight) - 1) <= 1e-6 AND min(weight) >= -1e-6 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM (SELECT * FROM weights UNION ALL SELECT 'Doubled', symbol, 2 * weight FROM weights WHERE portfolio = 'Equal-Weight') GROUP BY portfolio")
def constraint_check(spark: SparkSession, sf: str) -> DataFrame:
    w = weights(spark, sf)
    doubled = w.where("portfolio = 'Equal-Weight'").select(F.lit("Doubled").alias("portfolio"), "symbol", (2 * F.col("weight")).alias("weight"))
    return rounded(V.constraints(w.unionByName(doubled)), "total", "least", "gross")


@query("SELECT portfolio, round(max(abs(weight)), 6) + 0.0 AS largest, CASE WHEN max(abs(weight)) > 0.2 THEN 'FAIL' WHEN max(abs(weight)) > 0.1 THEN 'WARN' ELSE 'PASS' END AS verdict FROM weights GROUP BY portfolio")
def concentration_check(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.concentration_verdict(weights(spark, sf)), "largest")


@query("SELECT portfolio, round(r / p, 5) + 0.0 AS ratio, CASE WHEN r / p BETWEEN 0.5 AND 2 THEN 'PASS' ELSE 'WARN' END AS verdict FROM (SELECT portfolio, sqrt((factor_var + specific_var) * 12) AS p FROM prisk) JOIN (SELECT portfolio, stddev_samp(ret) * sqrt(12) AS r FROM pret GROUP BY portfolio) USING (portfolio)")
def realized_volatility(spark: SparkSession, sf: str) -> DataFrame:
    predicted = PF.risk_decomposition(weights(spark, sf), MD.regions(spark, sf), MD.factor_covariance(spark, sf), MD.specific(spark, sf), days=12)
    return rounded(V.realized_volatility(predicted, PF.performance(series(spark, sf), days=12)), "ratio", places=5)


@query()
def frontier_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Monotone volatility, convergence and consistent variances of the frontier, as verdicts."""
    cov = MD.covariance(spark, sf)
    points = PF.frontiers(PF.problem_rows(cov, MD.mus(spark, sf)), 8).persist()
    bad = V.variance_consistency(points, cov, 1e-6).groupBy().agg(F.sum((F.col("verdict") == "FAIL").cast("int")).alias("bad"))
    rows = [
        V.frontier_monotone(points).select(F.lit("monotone").alias("name"), "verdict"),
        V.convergence(points).select(F.lit("converged").alias("name"), F.when(F.col("n") == F.col("n_converged"), "PASS").otherwise("WARN").alias("verdict")),
        bad.select(F.lit("variance").alias("name"), F.when(F.col("bad") == 0, "PASS").otherwise("FAIL").alias("verdict")),
    ]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def sampled_sql(source: str, date: str = "date") -> str:
    """SQL of the sampled dates: every k-th of the source's."""
    return f"(SELECT date FROM (SELECT {date} AS date, row_number() OVER (ORDER BY {date}) - 1 AS i, greatest(1, floor(count(*) OVER () / 20)) AS k FROM (SELECT DISTINCT {date} FROM {source})) WHERE i % k = 0 AND i / k < 20)"


_D = len(MD.DESIGN)


@query(f"""WITH RECURSIVE m AS (SELECT target_date AS date, {MD._LIST} AS x FROM modelrows WHERE target_date IN {sampled_sql("modelrows", "target_date")}),
    g AS (SELECT date, i.i AS i, j.i AS j, sum(x[i.i] * x[j.i]) AS v FROM m, range(1, {_D + 1}) i(i), range(1, {_D + 1}) j(i) GROUP BY ALL HAVING count(*) >= {_D + 5}),
    cells AS (SELECT date, c.i AS c, g.i, g.j, g.v FROM g, range(1, {_D + 1}) c(i) UNION ALL SELECT date, c.i, i.i, {_D + 1}, CASE WHEN c.i = i.i THEN 1.0 ELSE 0.0 END FROM (SELECT DISTINCT date FROM g), range(1, {_D + 1}) c(i), range(1, {_D + 1}) i(i)),
    {MD.solved_sql("inverse", "cells", "date, c", _D)}
    SELECT {MD._DESIGN_NAMES}[i] AS factor, round(avg(n.v * g.v), 4) + 0.0 AS vif, count(*) AS n_dates FROM inverse n JOIN g USING (date, i) WHERE n.c = n.i AND g.j = g.i GROUP BY i""")
def variance_inflation(spark: SparkSession, sf: str) -> DataFrame:
    rows = MD.model_rows(spark, sf).withColumnRenamed("date", "asof").withColumnRenamed("target_date", "date")
    return rounded(V.variance_inflation(rows, MD.DESIGN), "vif", places=4)


@query(f"""WITH RECURSIVE m AS (SELECT date, symbol, residual * residual AS u, [1.0, {", ".join(B.REGION_COLUMNS[:4])}] AS x FROM resid JOIN shares_by_region USING (symbol) WHERE date IN {sampled_sql("resid")}),
    cells AS (SELECT date, i.i AS i, j.i AS j, sum(x[i.i] * CASE WHEN j.i = 6 THEN u ELSE x[j.i] END) AS v FROM m, range(1, 6) i(i), range(1, 7) j(i) GROUP BY ALL HAVING count(*) > 5),
    {MD.solved_sql("coef", "cells", "date", 5)},
    fitted AS (SELECT m.date, m.symbol, any_value(u) AS u, sum(x[c.i] * c.v) AS fit FROM m JOIN coef c ON c.date = m.date GROUP BY m.date, m.symbol),
    lm AS (SELECT date, count(*) AS n, count(*) * (1 - sum((u - fit) * (u - fit)) / sum((u - mu) * (u - mu))) AS lm FROM (SELECT *, avg(u) OVER (PARTITION BY date) AS mu FROM fitted) GROUP BY date)
    SELECT date, n, round(lm, 5) + 0.0 AS lm, round(exp(-lm / 2) * (1 + lm / 2), 5) + 0.0 AS p FROM lm""")
def breusch_pagan(spark: SparkSession, sf: str) -> DataFrame:
    rows = MD.region_residuals(spark, sf).join(B.industries(spark, sf), "symbol")
    return rounded(V.breusch_pagan(rows, B.REGION_COLUMNS[:4]), "lm", "p", places=5)


@query()
def dickey_fuller(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.dickey_fuller(MD.region_returns(spark, sf)), "t", places=5)


@query(f"{MD._FIT} SELECT count(*) AS n, round(avg(r2), 6) + 0.0 AS mean, round(median(r2), 6) + 0.0 AS median, round(stddev_samp(r2), 6) + 0.0 AS std FROM r2")
def r2_distribution(spark: SparkSession, sf: str) -> DataFrame:
    from quantloom.operators.regression import fit_statistics

    return rounded(V.r2_distribution(fit_statistics(MD.model_fits(spark, sf))), "mean", "median", "std")


# ---- plot tables -----------------------------------------------------------------------------------------------


@query("SELECT date, factor, round(product(1 + ret) OVER (PARTITION BY factor ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1, 6) + 0.0 AS cumulative FROM fret")
def plot_cumulative_factors(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(V.cumulative(MD.region_returns(spark, sf)).select("date", "factor", "cumulative"), "cumulative")


@query("SELECT bin, count(*) AS n FROM (SELECT CAST(least(199, floor((residual - lo) / ((hi - lo) / 200))) AS INTEGER) AS bin FROM resid, (SELECT min(residual) AS lo, max(residual) AS hi FROM resid)) GROUP BY bin")
def plot_residual_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return V.histogram(MD.region_residuals(spark, sf), "residual").select("bin", "n")


@query("SELECT date, round(1e4 * avg(residual), 4) + 0.0 AS alpha FROM mresid GROUP BY date")
def plot_daily_alpha(spark: SparkSession, sf: str) -> DataFrame:
    return market_residuals(spark, sf).groupBy("date").agg(r6(1e4 * F.avg("residual"), 4).alias("alpha"))


@query(f"{MD._FIT} SELECT date, round(r2, 6) + 0.0 AS r2, round(CASE WHEN count(r2) OVER w >= 5 THEN avg(r2) OVER w END, 6) + 0.0 AS r2_mean FROM ok LEFT JOIN r2 USING (date) WINDOW w AS (ORDER BY date ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)")
def plot_r2(spark: SparkSession, sf: str) -> DataFrame:
    from quantloom.operators.regression import fit_statistics

    return rounded(V.rolling_r2(fit_statistics(MD.model_fits(spark, sf))).select("date", "r2", "r2_mean"), "r2", "r2_mean")


@query("SELECT a.portfolio AS row, b.portfolio AS col, round(corr(a.ret, b.ret), 6) + 0.0 AS corr FROM pret a JOIN pret b USING (date) GROUP BY ALL")
def plot_portfolio_correlation(spark: SparkSession, sf: str) -> DataFrame:
    s = series(spark, sf)
    other = s.select("date", F.col("portfolio").alias("col"), F.col("ret").alias("r2"))
    return s.join(other, "date").groupBy(F.col("portfolio").alias("row"), "col").agg(r6(F.corr("ret", "r2")).alias("corr"))


# ---- parts of larger steps, each on its own --------------------------------------------------------------------


@query("SELECT date, symbol, round(ret - 0.055 / 252, 8) + 0.0 AS excess FROM drets")
def excess_returns(spark: SparkSession, sf: str) -> DataFrame:
    from quantloom.operators.regression import excess_return

    return rounded(excess_return(B.panel(spark, sf, "day")).select("date", "symbol", "excess"), "excess", places=8)


@query("SELECT name, month, round(momentum, 6) + 0.0 AS momentum FROM mom")
def macro_momentum(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(M.macro_momentum(MD.macro_prices(spark, sf)), "momentum")


@query("SELECT date, round(ret, 6) + 0.0 AS ret FROM spreads WHERE name = '1-URGENT'")
def group_spread(spark: SparkSession, sf: str) -> DataFrame:
    members = spark.createDataFrame([(s,) for s in GROUPS["1-URGENT"]], "symbol string")
    return rounded(M.group_spread(B.panel(spark, sf).select("date", "symbol", "ret"), members), "ret")


CTE["mspec"] = CTE["spec"].replace("raged", f"(SELECT r.*, pow(0.5, age / {MD.HALF}) AS w FROM mresid r JOIN (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS age FROM (SELECT DISTINCT date FROM mresid)) USING (date))")


@query("SELECT symbol, round(CASE WHEN segment = 'top' THEN s.specific_risk ELSE m.specific_risk END, 6) + 0.0 AS specific_risk FROM seg JOIN spec s USING (symbol) JOIN mspec m USING (symbol)")
def joint_specific_risk(spark: SparkSession, sf: str) -> DataFrame:
    """The large brands' risk is that of the region model, the others' that of the market model."""
    market = K.ewma_specific_risk(market_residuals(spark, sf), halflife=MD.HALF, days=12)
    return rounded(PF.joint_specific_risk({"top": MD.specific(spark, sf), "rest": market}, MD.segments(spark, sf)), "specific_risk")


@query("SELECT symbol, segment, CAST(segment = 'rest' AS DOUBLE) AS member, CASE WHEN segment = 'rest' THEN 0.05 ELSE 0.1 END::DOUBLE AS cap FROM seg")
def segment_caps(spark: SparkSession, sf: str) -> DataFrame:
    return PF.segment_caps(MD.segments(spark, sf), {"rest": 0.05}, group="rest")


@query("SELECT factor, CASE factor WHEN 'Materials' THEN 'Industry' WHEN 'psu_flag' THEN 'Indicator' ELSE 'Style' END AS type, n FROM (SELECT CASE factor WHEN 'africa' THEN 'Materials' WHEN 'asia' THEN 'psu_flag' ELSE factor END AS factor, count(*) AS n FROM fret GROUP BY ALL)")
def labelled_summary(spark: SparkSession, sf: str) -> DataFrame:
    from quantloom.sources.sinks import labelled_summary as labelled

    name = F.when(F.col("factor") == "africa", "Materials").when(F.col("factor") == "asia", "psu_flag").otherwise(F.col("factor"))
    return labelled(MD.region_returns(spark, sf).groupBy(name.alias("factor")).agg(F.count("*").alias("n"))).select("factor", "type", "n")
