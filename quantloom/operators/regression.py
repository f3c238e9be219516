"""Cross-sectional weighted regressions: exposures of one date explain the returns of the next."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.functions import constants as C
from quantloom.operators.panel import calendar, next_date


def excess_return(returns: DataFrame, ret: str = "ret", annual: float = C.RF_ANNUAL, days: int = C.TRADING_DAYS_PER_YEAR) -> DataFrame:
    return returns.withColumn("excess", F.col(ret) - annual / days)


def aligned(exposures: DataFrame, returns: DataFrame, ret: str = "ret", annual_rf: float = C.RF_ANNUAL, days: int = C.TRADING_DAYS_PER_YEAR) -> DataFrame:
    """Exposures with the return of the next date of the exposures' own calendar (not of the symbol's own rows)."""
    following = next_date(calendar(exposures))
    ahead = returns.select(F.col("date").alias("target_date"), "symbol", F.col(ret).alias("raw_return"), (F.col(ret) - annual_rf / days).alias("y"))
    return exposures.join(F.broadcast(following), "date").join(ahead, ["target_date", "symbol"])


def split_outliers(rows: DataFrame, limit: float = C.CORPORATE_ACTION_RETURN) -> tuple[DataFrame, DataFrame]:
    """Rows to regress, and those whose return is beyond ``limit`` either way; a null return stays with the first."""
    far = F.coalesce(F.abs("raw_return") > limit, F.lit(False))
    return rows.where(~far), rows.where(far)


def complete_cases(rows: DataFrame, design: list[str], cap: str = "market_cap") -> DataFrame:
    return rows.dropna(subset=[*design, "y", cap]).where(F.col(cap) > 0)


def fit_one(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
    """Weighted least squares of least norm. The total sum of squares is centred if the columns span a constant."""
    root = np.sqrt(weight)
    coef = np.linalg.pinv(x * root[:, None]) @ (y * root)
    fitted = x @ coef
    resid = y - fitted
    rank = np.linalg.matrix_rank(x * root[:, None])
    constant = np.linalg.matrix_rank(np.column_stack((np.ones(len(y)), x)) * root[:, None]) == rank
    centre = np.average(y, weights=weight) if constant else 0.0
    total, rest = float(weight @ (y - centre) ** 2), float(weight @ resid**2)
    r2 = 1 - rest / total if total > 0 else np.nan
    adjusted = 1 - (1 - r2) * (len(y) - int(constant)) / (len(y) - rank) if len(y) > rank else np.nan
    return {"coef": coef, "fitted": fitted, "resid": resid, "r2": r2, "adj_r2": adjusted}


def cross_sectional_fits(rows: DataFrame, design: list[str], cap: str = "market_cap", least: int = C.MIN_N_PER_DAY, flat: float = C.DEGENERATE_STD) -> DataFrame:
    """One fit a target date, weighted by the root of ``cap``: coefficients, fits and residuals in long form.

    Kinds: ``coef`` (name, value), ``resid`` (name = symbol, value = residual, fitted), ``stat`` (r2, adj_r2, n).
    Dates with fewer than ``least`` rows are ``skipped_low_n``, those without spread ``degenerate``.
    """
    schema = "target_date date, kind string, name string, value double, fitted double, status string"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        date = pdf["target_date"].iloc[0]
        n = len(pdf)
        y = pdf["y"].to_numpy(float)
        status = "skipped_low_n" if n < least else "degenerate" if np.std(y, ddof=1) < flat else "fitted"
        out = [(date, "stat", "n", float(n), None, status)]
        if status == "fitted":
            pdf = pdf.sort_values("symbol")
            got = fit_one(pdf[design].to_numpy(float), pdf["y"].to_numpy(float), np.sqrt(pdf[cap].to_numpy(float)))
            out += [(date, "stat", k, got[k], None, status) for k in ("r2", "adj_r2")]
            out += [(date, "coef", f, c, None, status) for f, c in zip(design, got["coef"], strict=True)]
            out += [(date, "resid", s, r, f, status) for s, r, f in zip(pdf["symbol"], got["resid"], got["fitted"], strict=True)]
        return pd.DataFrame(out, columns=["target_date", "kind", "name", "value", "fitted", "status"])

    return rows.select("target_date", "symbol", "y", cap, *design).groupBy("target_date").applyInPandas(fit, schema)


def factor_returns(fits: DataFrame) -> DataFrame:
    return fits.where("kind = 'coef'").select(F.col("target_date").alias("date"), F.col("name").alias("factor"), F.col("value").alias("ret"))


def residuals(fits: DataFrame) -> DataFrame:
    return fits.where("kind = 'resid'").select(F.col("target_date").alias("date"), F.col("name").alias("symbol"), F.col("value").alias("residual"), "fitted")


def fit_statistics(fits: DataFrame) -> DataFrame:
    stat = fits.where("kind = 'stat'")
    pick = [F.max(F.when(F.col("name") == k, F.col("value"))).alias(k) for k in ("n", "r2", "adj_r2")]
    return stat.groupBy(F.col("target_date").alias("date"), "status").agg(*pick).withColumn("n", F.col("n").cast("long"))


def univariate_fit(rows: DataFrame, x: str, cap: str = "market_cap") -> DataFrame:
    """The fit with a constant and one factor, in closed form: no Python, one aggregation by date."""
    w = F.sqrt(cap)
    sums = rows.groupBy("target_date").agg(F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(w * F.col(x)).alias("sx"), F.sum(w * F.col("y")).alias("sy"), F.sum(w * F.col(x) * F.col(x)).alias("sxx"), F.sum(w * F.col(x) * F.col("y")).alias("sxy"))
    det = F.col("sw") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = (F.col("sw") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.when(det != 0, det)
    return sums.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("sw")).select(F.col("target_date").alias("date"), "n", "slope", "intercept")


def group_means_fit(rows: DataFrame, group: str, cap: str = "market_cap") -> DataFrame:
    """The fit on one-hot groups, which is each group's weighted mean."""
    w = F.sqrt(cap)
    return rows.groupBy(F.col("target_date").alias("date"), F.col(group).alias("factor")).agg((F.sum(w * F.col("y")) / F.sum(w)).alias("ret"))


def regression_tables(fits: DataFrame, flagged: DataFrame) -> dict[str, DataFrame]:
    """What a regression run writes."""
    return {"factor_returns": factor_returns(fits), "r2_daily": fit_statistics(fits), "residuals_long": residuals(fits), "flagged": flagged}

