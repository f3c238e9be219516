"""Walk-forward backtests on the factor model. Rebalances do not depend on each other, so all of them run side by side;
only turnover looks at the rebalance before, and that is a join afterwards.

Daily factor returns, residuals and exposures are point-in-time as they stand, so a rebalance takes what is dated up to
it: factor series are dealt to the rebalances, symbols' specific risks run along time, exposures are looked up."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import constants as C
from quantloom.functions.solver import Limits, frontier
from quantloom.operators import inference as I
from quantloom.operators import portfolio as PF
from quantloom.operators import risk as K
from quantloom.operators.panel import month_end_dates


def rebalance_dates(dates: DataFrame, start: str) -> DataFrame:
    """(as_of, until): month ends from the month before ``start``, each with the one that follows it (or none)."""
    first = F.add_months(F.trunc(F.lit(start).cast("date"), "month"), -1)
    ends = month_end_dates(dates).where(F.trunc("date", "month") >= first)
    return ends.select(F.col("date").alias("as_of"), F.lead("date").over(Window.orderBy("date")).alias("until"))


def held_returns(weights: DataFrame, rebalances: DataFrame, returns: DataFrame) -> DataFrame:
    """(portfolio, date, ret): the weights of a rebalance earn the returns after it, up to and with the next one.

    ``weights``: (portfolio, as_of, symbol, weight). Each date is given its rebalance once (a lookup in the short
    list of rebalances, broadcast), so weights and returns meet in an equi-join.
    """
    dates = returns.select("date").distinct()
    spans = F.broadcast(rebalances)
    held = dates.join(spans, (F.col("date") > F.col("as_of")) & (F.col("until").isNull() | (F.col("date") <= F.col("until"))))
    rows = returns.join(F.broadcast(held.select("date", "as_of")), "date").join(weights, ["as_of", "symbol"])
    return rows.groupBy("portfolio", "date").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("ret"))


def turnover(weights: DataFrame) -> DataFrame:
    """(portfolio, as_of, turnover): half the absolute change of target weights, from the second rebalance on."""
    dates = weights.select("portfolio", "as_of").distinct()
    order = Window.partitionBy("portfolio").orderBy("as_of")
    pairs = dates.withColumn("prior", F.lag("as_of").over(order)).where("prior IS NOT NULL")
    now = pairs.join(weights, ["portfolio", "as_of"]).select("portfolio", "as_of", "symbol", "weight")
    before = pairs.join(weights.select("portfolio", F.col("as_of").alias("prior"), "symbol", (-F.col("weight")).alias("weight")), ["portfolio", "prior"]).select("portfolio", "as_of", "symbol", "weight")
    change = now.unionByName(before).groupBy("portfolio", "as_of", "symbol").agg(F.sum("weight").alias("d"))
    return change.groupBy("portfolio", "as_of").agg((F.sum(F.abs("d")) / 2).alias("turnover"))


def as_seen(df: DataFrame, rebalances: DataFrame) -> DataFrame:
    """A short list of series dealt to the rebalances: each has the rows dated up to it, with ``as_of``."""
    return df.join(F.broadcast(rebalances.select("as_of")), F.col("date") <= F.col("as_of"))


def factor_models(factor_returns: DataFrame, rebalances: DataFrame, halflife: float = C.EWMA_HALFLIFE, t_min: float = C.SHRINK_T_MIN, common: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(as_of, row, col, cov) and (as_of, factor, expected): the factor model as of each rebalance.

    Factors are a short list, so their history is dealt to the rebalances. ``common`` are the series of the covariance
    if these are not all of ``factor_returns``.
    """
    within = ("as_of",)
    seen = as_seen(factor_returns.select("date", "factor", "ret"), rebalances)
    cov = K.ewma_covariance(seen if common is None else as_seen(common, rebalances), halflife=halflife, within=within)
    expected = K.expected_factor_returns(I.summary(seen, ["as_of", "factor"]), K.ewma_mean(seen, halflife=halflife, within=within), t_min=t_min, within=within)
    return cov, expected.select("as_of", "factor", "expected")


def latest_as_of(panel: DataFrame, rebalances: DataFrame, complete: list[str]) -> DataFrame:
    """The rows of ``panel`` with all of ``complete`` on the last date that has any, up to each rebalance, with ``as_of``."""
    good = panel.dropna(subset=complete)
    dates = F.broadcast(good.select("date").distinct())
    last = dates.join(F.broadcast(rebalances.select("as_of")), F.col("date") <= F.col("as_of")).groupBy("as_of").agg(F.max("date").alias("date"))
    return good.join(F.broadcast(last), "date")


def specific_as_of(residuals: DataFrame, rebalances: DataFrame, halflife: float = C.EWMA_HALFLIFE, days: int = C.TRADING_DAYS_PER_YEAR) -> DataFrame:
    """(as_of, symbol, specific_risk): the last of each symbol's running risks up to each rebalance.

    A date belongs to the first rebalance on or after it; a symbol's last risk of that span also serves the rebalances
    after it, up to its next span.
    """
    running = K.running_specific_risk(residuals, halflife=halflife, days=days).where("specific_risk IS NOT NULL")
    dates = F.broadcast(rebalances.select("as_of"))
    first = running.select("date").distinct().join(dates, F.col("as_of") >= F.col("date")).groupBy("date").agg(F.min("as_of").alias("span"))
    ends = running.join(F.broadcast(first), "date").groupBy("symbol", "span").agg(F.max_by("specific_risk", "date").alias("specific_risk"))
    every = rebalances.agg(F.array_sort(F.collect_set("as_of")).alias("every"))
    kept = ends.withColumn("next", F.lead("span").over(Window.partitionBy("symbol").orderBy("span"))).crossJoin(F.broadcast(every))
    serves = F.filter("every", lambda d: (d >= F.col("span")) & (F.col("next").isNull() | (d < F.col("next"))))
    return kept.select(F.explode(serves).alias("as_of"), "symbol", "specific_risk")


def problems(exposures: DataFrame, design: list[str], cov: DataFrame, expected: DataFrame, specific: DataFrame, keep: list[str] | None = None, tilts: DataFrame | None = None, days: int = C.TRADING_DAYS_PER_YEAR) -> DataFrame:
    """One row a symbol of a rebalance: its exposures, specific variance, tilt, the columns ``keep``, and the factor model.

    ``exposures`` is (as_of, symbol, design...). The stock covariance itself, all pairs of symbols, is formed in the task
    that solves the rebalance and nowhere else.
    """
    names = F.array(*[F.lit(c) for c in design])
    cells = cov.groupBy("as_of").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "row", "col"), "cov"))).alias("cells"))
    means = expected.groupBy("as_of").agg(F.map_from_entries(F.collect_list(F.struct("factor", "expected"))).alias("means"))
    # one row a rebalance, of at most as many cells as the design has pairs
    model = cells.join(means, "as_of").select("as_of", F.transform(names, lambda r: F.transform(names, lambda c: F.coalesce(F.col("cells")[F.concat_ws("|", r, c)], F.lit(0.0)))).alias("cov"), F.transform(names, lambda r: F.coalesce(F.col("means")[r], F.lit(0.0))).alias("means"))
    x = exposures.select("as_of", "symbol", *(keep or []), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in design]).alias("x"))
    rows = x.join(specific.select("as_of", "symbol", (F.col("specific_risk") * F.col("specific_risk") / days).alias("own")), ["as_of", "symbol"])
    rows = rows.withColumn("tilt", F.lit(0.0)) if tilts is None else rows.join(tilts, ["as_of", "symbol"], "left").fillna({"tilt": 0.0})
    # the model goes along with one row of each rebalance only
    first = F.row_number().over(Window.partitionBy("as_of").orderBy("symbol")) == 1
    both = rows.withColumn("_first", first).join(F.broadcast(model), "as_of")
    return both.withColumns({c: F.when(F.col("_first"), F.col(c)) for c in ("cov", "means")}).drop("_first")


def joint_problems(exposures: DataFrame, design: list[str], factor_returns: dict[str, DataFrame], residuals: dict[str, DataFrame], rebalances: DataFrame, halflife: float = C.EWMA_HALFLIFE, days: int = C.TRADING_DAYS_PER_YEAR, t_min: float = C.SHRINK_T_MIN, tilts: DataFrame | None = None) -> DataFrame:
    """:func:`problems` of the joint model of segments, each with factor returns and residuals of its own.

    ``exposures`` has (date, symbol, design..., segment); a symbol is in the segment of its row as of the rebalance, and
    takes that segment's specific risk.
    """
    names = list(factor_returns)
    each = None
    for s, df in factor_returns.items():
        part = df.select("date", F.concat("factor", F.lit(f"__{s}")).alias("factor"), "ret")
        each = part if each is None else each.unionByName(part)
    cov, expected = factor_models(each, rebalances, halflife, t_min, common=PF.joint_factor_returns(factor_returns))
    now = latest_as_of(exposures.where("segment IS NOT NULL"), rebalances, design)
    risk = None
    for s, df in residuals.items():
        part = specific_as_of(df.select("date", "symbol", "residual"), rebalances, halflife, days).withColumn("segment", F.lit(s))
        risk = part if risk is None else risk.unionByName(part)
    own = risk.join(now.select("as_of", "symbol", "segment"), ["as_of", "symbol", "segment"], "left_semi")
    wide = now.select("as_of", "symbol", "segment", *[F.when(F.col("segment") == s, F.col(c)).otherwise(F.lit(0.0)).alias(f"{c}__{s}") for s in names for c in design])
    return problems(wide, PF.joint_columns(design, names), cov, expected, own, ["segment"], tilts, days)


def walk_forward(rows: DataFrame, points: int = C.BACKTEST_FRONTIER_POINTS, limits: Callable[[pd.DataFrame], Limits] | None = None) -> DataFrame:
    """(portfolio, as_of, symbol, weight) of the least-variance, best-Sharpe and equal portfolios of every rebalance.

    ``rows`` are :func:`problems`; each rebalance is solved in one task. ``limits`` sees its rows (symbol, x and what was
    kept), in the order of symbols. Where no point of the frontier converges the portfolio is left out.
    """
    schema = "portfolio string, as_of date, symbol string, weight double"

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("symbol").reset_index(drop=True)
        told = pdf[pdf["cov"].notna()].iloc[0]
        x = np.array(pdf["x"].tolist(), float)
        sigma = x @ np.array([list(r) for r in told["cov"]], float) @ x.T + np.diag(pdf["own"].to_numpy(float))
        mu = x @ np.array(told["means"], float) + pdf["tilt"].to_numpy(float)
        lim = limits(pdf) if limits else Limits(cap=C.MAX_STOCK_WEIGHT, soft=True, penalty=C.STOCK_SOFT_PENALTY)
        path = [p for p in frontier((sigma + sigma.T) / 2, mu, points, lim) if p["converged"]]
        picks = {"Equal-Weight": np.full(len(pdf), 1 / len(pdf))}
        if path and path[0]["point"] == 0:
            picks["GMV"] = path[0]["weights"]
        if path:
            picks["Max-Sharpe"] = max(path, key=lambda p: p["sharpe"] if p["sharpe"] is not None else -np.inf)["weights"]
        return pd.concat([pd.DataFrame({"portfolio": name, "as_of": told["as_of"], "symbol": pdf["symbol"], "weight": w}) for name, w in picks.items()])

    return rows.groupBy("as_of").applyInPandas(solve, schema)
