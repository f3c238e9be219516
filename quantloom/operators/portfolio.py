"""Portfolios: weights (portfolio, symbol, weight), their risk, concentration and performance, and optimization jobs.

Analytics are relational. Optimization problems are small dense programs, one a task: a frontier's targets or a
backtest's dates are rows, and each is solved where it lands.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import constants as C
from quantloom.functions.solver import Limits, frontier_point, frontier_targets, minimum_variance


def equal_weights(symbols: DataFrame, name: str = "Equal-Weight") -> DataFrame:
    n = F.broadcast(symbols.agg(F.count("*").alias("_n")))
    return symbols.crossJoin(n).select(F.lit(name).alias("portfolio"), "symbol", (1.0 / F.col("_n")).alias("weight"))


def inverse_variance_weights(variances: DataFrame, name: str = "Inverse-Variance") -> DataFrame:
    """Least variance for a diagonal covariance, from (symbol, variance)."""
    w = 1.0 / F.col("variance")
    total = F.broadcast(variances.agg(F.sum(w).alias("_total")))
    return variances.crossJoin(total).select(F.lit(name).alias("portfolio"), "symbol", (w / F.col("_total")).alias("weight"))


def factor_exposure(weights: DataFrame, exposures: DataFrame) -> DataFrame:
    """(portfolio, factor, exposure)."""
    return weights.join(exposures, "symbol").groupBy("portfolio", "factor").agg(F.sum(F.col("weight") * F.col("x")).alias("exposure"))


def risk_decomposition(weights: DataFrame, exposures: DataFrame, factor_cov: DataFrame, specific: DataFrame, days: int = C.TRADING_DAYS_PER_YEAR) -> DataFrame:
    """Daily factor and specific variance, their shares, and the annual volatility of each portfolio."""
    # factors are few, so a portfolio's exposures are one map and the covariance one array: no join of pairs
    maps = factor_exposure(weights, exposures).groupBy("portfolio").agg(F.map_from_entries(F.collect_list(F.struct("factor", "exposure"))).alias("e"))
    cells = factor_cov.agg(F.collect_list(F.struct("row", "col", "cov")).alias("cells"))
    add = F.aggregate("cells", F.lit(0.0), lambda a, c: a + F.coalesce(F.col("e")[c["row"]] * c["cov"] * F.col("e")[c["col"]], F.lit(0.0)))
    common = maps.crossJoin(F.broadcast(cells)).select("portfolio", add.alias("factor_var"))
    own = weights.join(specific, "symbol").groupBy("portfolio").agg((F.sum(F.col("weight") * F.col("weight") * F.col("specific_risk") * F.col("specific_risk")) / days).alias("specific_var"))
    both = common.join(own, "portfolio")
    total = F.col("factor_var") + F.col("specific_var")
    return both.select("portfolio", "factor_var", "specific_var", (F.col("factor_var") / F.when(total != 0, total)).alias("factor_pct"), (F.col("specific_var") / F.when(total != 0, total)).alias("specific_pct"), F.sqrt(total * days).alias("ann_vol"))


def concentration(weights: DataFrame) -> DataFrame:
    """Holdings, Herfindahl index, effective number and the absolute weight of the largest 1, 5 and 10."""
    a = F.abs("weight")
    ranked = weights.withColumn("_r", F.row_number().over(Window.partitionBy("portfolio").orderBy(F.desc(a), "symbol")))
    hhi = F.sum(F.when(a > 1e-9, F.col("weight") * F.col("weight")).otherwise(0.0))
    top = [F.sum(F.when(F.col("_r") <= k, a).otherwise(0.0)).alias(f"top{k}") for k in (1, 5, 10)]
    return ranked.groupBy("portfolio").agg(F.sum(F.when(a > 1e-6, 1).otherwise(0)).cast("long").alias("n_holdings"), hhi.alias("hhi"), (1.0 / F.when(hhi > 0, hhi)).alias("effective_n"), *top)


def top_holdings(weights: DataFrame, k: int) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("portfolio").orderBy(F.desc(F.abs("weight")), "symbol"))
    return weights.withColumn("rank", r).where(F.col("rank") <= k)


def sector_weights(weights: DataFrame, sectors: DataFrame) -> DataFrame:
    """(portfolio, factor, weight) from weights and fractional sectors (symbol, factor, x)."""
    return factor_exposure(weights, sectors).withColumnRenamed("exposure", "weight")


def return_series(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """(portfolio, date, ret): fixed weights over all dates of ``returns``; a missing return counts as none.

    Weights are scaled to the symbols that the returns have.
    """
    there = weights.join(returns.select("symbol").distinct(), "symbol", "left_semi")
    scaled = there.withColumn("weight", F.col("weight") / F.sum("weight").over(Window.partitionBy("portfolio")))
    return returns.join(scaled, "symbol").groupBy("portfolio", "date").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("ret"))


def drawdowns(series: DataFrame) -> DataFrame:
    """(portfolio, date, ret, cumulative, drawdown)."""
    w = Window.partitionBy("portfolio").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = series.withColumn("cumulative", F.product(1 + F.col("ret")).over(w))
    peak = F.max("cumulative").over(w)
    return grown.withColumn("drawdown", F.col("cumulative") / peak - 1)


def performance(series: DataFrame, days: int = C.TRADING_DAYS_PER_YEAR, turnover: DataFrame | None = None) -> DataFrame:
    """Total and annual return (geometric), volatility, Sharpe ratio, worst drawdown, Calmar ratio, mean turnover."""
    out = drawdowns(series).groupBy("portfolio").agg(F.count("*").alias("n"), (F.product(1 + F.col("ret")) - 1).alias("total_return"), (F.stddev_samp("ret") * days**0.5).alias("ann_vol"), F.min("drawdown").alias("max_drawdown"))
    out = out.withColumn("ann_return", F.pow(1 + F.col("total_return"), F.lit(float(days)) / F.col("n")) - 1)
    out = out.withColumn("sharpe", F.col("ann_return") / F.when(F.col("ann_vol") > 0, F.col("ann_vol"))).withColumn("calmar", F.col("ann_return") / F.when(F.col("max_drawdown") < 0, F.abs("max_drawdown")))
    out = out.select("portfolio", "n", "total_return", "ann_return", "ann_vol", "sharpe", "max_drawdown", "calmar")
    return out.join(turnover.groupBy("portfolio").agg(F.avg("turnover").alias("avg_turnover")), "portfolio", "left") if turnover is not None else out


def benchmark_relative(series: DataFrame, benchmark: DataFrame, days: int = C.TRADING_DAYS_PER_YEAR) -> DataFrame:
    """Beta, alpha, tracking error, information ratio, correlation and capture against (date, bench)."""
    both = series.join(benchmark.select("date", "bench"), "date").where("ret IS NOT NULL AND bench IS NOT NULL")
    active = F.col("ret") - F.col("bench")
    up, down = (F.when(t, F.col(c)) for t in (F.col("bench") > 0, F.col("bench") < 0) for c in ("ret",))
    bench_up, bench_down = F.when(F.col("bench") > 0, F.col("bench")), F.when(F.col("bench") < 0, F.col("bench"))
    sums = both.groupBy("portfolio").agg(
        F.count("*").alias("n"),
        (F.covar_samp("ret", "bench") / F.var_samp("bench")).alias("beta"),
        (F.avg("ret") * days).alias("_mean"),
        (F.avg("bench") * days).alias("_bench"),
        (F.stddev_samp(active) * days**0.5).alias("tracking_error"),
        (F.avg(active) * days).alias("_active"),
        F.corr("ret", "bench").alias("correlation"),
        (F.avg(up) / F.avg(bench_up)).alias("up_capture"),
        (F.avg(down) / F.avg(bench_down)).alias("down_capture"),
    )
    out = sums.withColumn("alpha", F.col("_mean") - F.col("beta") * F.col("_bench"))
    return out.withColumn("information_ratio", F.col("_active") / F.when(F.col("tracking_error") > 0, F.col("tracking_error"))).drop("_mean", "_bench", "_active")


def comparison(risk: DataFrame, concentrated: DataFrame, mu: DataFrame, weights: DataFrame, days: int = C.TRADING_DAYS_PER_YEAR) -> DataFrame:
    """One row a portfolio: annual expected return, volatility, Sharpe ratio, risk shares and concentration."""
    ret = weights.join(mu, "symbol").groupBy("portfolio").agg((F.sum(F.col("weight") * F.col("mu")) * days).alias("ann_return"))
    out = risk.join(concentrated, "portfolio").join(ret, "portfolio")
    return out.withColumn("sharpe", F.col("ann_return") / F.when(F.col("ann_vol") > 0, F.col("ann_vol"))).select("portfolio", "ann_return", "ann_vol", "sharpe", "factor_pct", "specific_pct", "n_holdings", "hhi", "effective_n", "top1", "top5", "top10")


# ---- segments --------------------------------------------------------------------------------------------------


def joint_columns(design: list[str], segments: list[str]) -> list[str]:
    return [f"{c}__{s}" for s in segments for c in design]


def joint_exposures(exposures: DataFrame, design: list[str], segments: list[str], label: str = "segment") -> DataFrame:
    """Each factor once a segment, zero outside it. A symbol in two segments is an error, raised by the task that finds it."""
    both = F.count("*").over(Window.partitionBy("symbol"))
    checked = exposures.withColumn("_n", both).withColumn("_ok", F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("symbol in two segments: "), F.col("symbol")))).otherwise(F.lit(True)))
    cols = [F.when(F.col(label) == s, F.col(c)).otherwise(F.lit(0.0)).alias(f"{c}__{s}") for s in segments for c in design]
    return checked.where("_ok").select("symbol", label, *cols)


def joint_factor_returns(by_segment: dict[str, DataFrame]) -> DataFrame:
    """(date, factor, ret) with suffixed factors, on the dates that all segments have."""
    parts = [df.select("date", F.concat("factor", F.lit(f"__{s}")).alias("factor"), "ret", F.lit(s).alias("_s")) for s, df in by_segment.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    common = both.groupBy("date").agg(F.countDistinct("_s").alias("n")).where(F.col("n") == len(parts)).select("date")
    return both.join(F.broadcast(common), "date", "left_semi").drop("_s")


def joint_specific_risk(by_segment: dict[str, DataFrame], members: DataFrame) -> DataFrame:
    """Each symbol's specific risk from the model of the segment it is in now."""
    out = None
    for s, df in by_segment.items():
        part = df.join(members.where(F.col("segment") == s).select("symbol"), "symbol", "left_semi")
        out = part if out is None else out.unionByName(part)
    return out


def segment_caps(members: DataFrame, caps: dict[str, float], group: str, default: float = C.MAX_STOCK_WEIGHT) -> DataFrame:
    """(symbol, segment, member, cap): membership of the segment ``group`` as 0 or 1, and each symbol's own cap by segment."""
    cap = F.lit(default)
    for s, c in caps.items():
        cap = F.when(F.col("segment") == s, F.lit(c)).otherwise(cap)
    return members.select("symbol", "segment", (F.col("segment") == group).cast("double").alias("member"), cap.cast("double").alias("cap"))


# ---- optimization ----------------------------------------------------------------------------------------------

FRONTIER_SCHEMA = "problem string, point int, target double, expected_return double, volatility double, sharpe double, converged boolean, symbol string, weight double"


def problem_rows(cov: DataFrame, mu: DataFrame, problem: str = "all") -> DataFrame:
    """One row a symbol of a problem: its expected return and its row of the covariance as (col, cov) pairs."""
    rows = cov.groupBy(F.col("row").alias("symbol")).agg(F.collect_list(F.struct("col", "cov")).alias("covs"))
    return rows.join(mu, "symbol").select(F.lit(problem).alias("problem"), "symbol", "mu", "covs")


def dense(pdf: pd.DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("symbol")
    symbols = list(pdf["symbol"])
    at = {s: i for i, s in enumerate(symbols)}
    sigma = np.zeros((len(symbols), len(symbols)))
    for i, covs in enumerate(pdf["covs"]):
        for c in covs:
            j = at.get(c["col"])
            if j is not None:
                sigma[i, j] = c["cov"]
    return symbols, (sigma + sigma.T) / 2, pdf["mu"].to_numpy(float)


def frontiers(problems: DataFrame, points: int = C.FRONTIER_POINTS, limits: Callable[[list[str]], Limits] | None = None) -> DataFrame:
    """Efficient frontiers: each point with its figures and its weights by symbol.

    One task a problem finds the ends and with them the targets; then each (problem, target) is solved where it lands.
    """

    def bounds(symbols: list[str]) -> Limits:
        return limits(symbols) if limits else Limits(cap=C.MAX_STOCK_WEIGHT, soft=True, penalty=C.STOCK_SOFT_PENALTY)

    def ends(pdf: pd.DataFrame) -> pd.DataFrame:
        symbols, sigma, mu = dense(pdf)
        targets, low, ok, ok_high = frontier_targets(sigma, mu, points, bounds(symbols))
        return pd.DataFrame([(pdf["problem"].iloc[0], k, float(t), bool(ok_high), bool(ok), low.tolist() if k == 0 else None) for k, t in enumerate(targets)], columns=["problem", "point", "target", "high", "ok", "low"])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        symbols, sigma, mu = dense(pdf)
        told = pdf.iloc[0]
        found = (np.array(told["low"], float), told["ok"]) if told["point"] == 0 else minimum_variance(sigma, bounds(symbols), mu, float(told["target"]))
        p = frontier_point(sigma, mu, int(told["point"]), float(told["target"]), (found[0], found[1] and told["high"]))
        rows = [(told["problem"], p["point"], p["target"], p["expected_return"], p["volatility"], p["sharpe"], p["converged"], s, float(w)) for s, w in zip(symbols, p["weights"], strict=True)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FRONTIER_SCHEMA.split(", ")])

    targets = problems.groupBy("problem").applyInPandas(ends, "problem string, point int, target double, high boolean, ok boolean, low array<double>")
    return problems.join(targets, "problem").groupBy("problem", "point").applyInPandas(solve, FRONTIER_SCHEMA)


def max_sharpe(points: DataFrame) -> DataFrame:
    """The weights of each problem's point with the best Sharpe ratio among those that converged."""
    rank = F.max_by("point", F.when(F.col("converged"), F.struct("sharpe", -F.col("point")))).over(Window.partitionBy("problem"))
    return points.withColumn("_best", rank).where("point = _best AND converged").drop("_best")


def global_minimum(points: DataFrame) -> DataFrame:
    return points.where("point = 0")

