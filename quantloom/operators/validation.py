"""Checks of a fitted model and of portfolios. A check yields rows (name, statistic, threshold, verdict, detail)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions import constants as C
from quantloom.functions.special import adf_critical, chi2_tail
from quantloom.operators.inference import newey_west_mean

#: Most names of a covariance that is looked at as one dense matrix.
LARGEST = 4_000
VERDICT = "name string, statistic string, threshold string, verdict string, detail string"


def verdict(df: DataFrame, name: str, statistic: Column, threshold: Column | str, passed: Column, detail: Column, otherwise: str = "FAIL") -> DataFrame:
    return df.select(F.lit(name).alias("name"), F.format_number(statistic, 4).alias("statistic"), (F.lit(threshold) if isinstance(threshold, str) else threshold).alias("threshold"), F.when(passed, "PASS").otherwise(otherwise).alias("verdict"), detail.alias("detail"))


def r2_distribution(stats: DataFrame) -> DataFrame:
    good = stats.where("r2 IS NOT NULL AND NOT isnan(r2)")
    return good.agg(F.count("*").alias("n"), F.avg("r2").alias("mean"), F.median("r2").alias("median"), F.stddev_samp("r2").alias("std"))


def significant_factors(summary: DataFrame, limit: float = 2.0) -> DataFrame:
    return summary.agg(F.count("*").alias("n"), F.sum((F.abs("nw_t") > limit).cast("int")).cast("long").alias("n_significant"))


def jarque_bera(values: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n, skewness, excess kurtosis, statistic and p (the chi-square tail with two degrees of freedom)."""
    good = values.where(F.col(value).isNotNull())
    out = good.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"))
    jb = F.col("n") / 6.0 * (F.col("skew") * F.col("skew") + F.col("kurt") * F.col("kurt") / 4.0)
    return out.withColumn("jb", jb).withColumn("p", F.exp(-F.col("jb") / 2.0))


def residual_alpha(residuals: DataFrame, by: list[str] | None = None, limit: float = 2.0) -> DataFrame:
    """The mean residual of a date, as a series, has a robust t; beyond ``limit`` the model leaves an alpha."""
    keys = by or []
    daily = residuals.groupBy(*keys, "date").agg(F.avg("residual").alias("ret"))
    if not keys:
        daily, keys = daily.withColumn("segment", F.lit("all")), ["segment"]
    out = newey_west_mean(daily, keys)
    return out.withColumn("verdict", F.when(F.abs("nw_t") > limit, "FAIL").otherwise("PASS"))


def industry_sums(exposures: DataFrame, columns: list[str], tolerance: float = 1e-3) -> DataFrame:
    """Rows whose industry weights do not sum to one; nulls count as zero."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in columns), F.lit(0.0))
    return exposures.withColumn("total", total).where(F.abs(F.col("total") - 1) > tolerance)


def look_ahead(panel: DataFrame, events: DataFrame, value: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows of a panel whose value is that of a report not yet visible on their date, and of none that is.

    Compares what the panel really holds with what was public: events are (symbol, visible, value).
    """
    reports = events.select("symbol", "visible", F.col(value).alias("_v"))
    both = panel.where(F.col(value).isNotNull()).join(reports, "symbol")
    same = F.abs(F.col("_v") - F.col(value)) <= tolerance * F.greatest(F.abs("_v"), F.lit(1.0))
    seen = both.groupBy("symbol", "date").agg(F.max((same & (F.col("visible") <= F.col("date"))).cast("int")).alias("public"), F.max((same & (F.col("visible") > F.col("date"))).cast("int")).alias("early"))
    return seen.where("early = 1 AND public = 0").select("symbol", "date")


def welch(rows: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """mean_a, mean_b, t and degrees of freedom of the difference b - a with unequal variances."""
    pick = lambda k: F.when(F.col(group) == k, F.col(value))
    s = rows.agg(*[f(pick(k)).alias(f"{n}{i}") for i, k in (("a", a), ("b", b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    qa, qb = F.col("va") / F.col("na"), F.col("vb") / F.col("nb")
    return s.select(F.col("ma").alias("mean_a"), F.col("mb").alias("mean_b"), ((F.col("mb") - F.col("ma")) / F.sqrt(qa + qb)).alias("t"), ((qa + qb) * (qa + qb) / (qa * qa / (F.col("na") - 1) + qb * qb / (F.col("nb") - 1))).alias("df"))


def ljung_box(series: DataFrame, by: str = "symbol", value: str = "residual", lags: int = 5, least: int = 30) -> DataFrame:
    """by, n, q: of autocorrelations up to ``lags``; short series are left out."""
    w = Window.partitionBy(by)
    good = series.where(F.col(value).isNotNull()).select(by, "date", (F.col(value) - F.avg(value).over(w)).alias("u"))
    lagged = good.withColumns({f"l{k}": F.lag("u", k).over(w.orderBy("date")) for k in range(1, lags + 1)})
    sums = lagged.groupBy(by).agg(F.count("*").alias("n"), F.sum(F.col("u") * F.col("u")).alias("s0"), *[F.sum(F.col("u") * F.col(f"l{k}")).alias(f"s{k}") for k in range(1, lags + 1)])
    total = sum((F.pow(F.col(f"s{k}") / F.col("s0"), F.lit(2.0)) / (F.col("n") - k) for k in range(1, lags + 1)), F.lit(0.0))
    return sums.where(F.col("n") >= least).select(by, "n", (F.col("n") * (F.col("n") + 2) * total).alias("q"))


def chi2_share(statistics: DataFrame, column: str, df: int, level: float = 0.05) -> DataFrame:
    """Share of rows whose chi-square statistic is beyond the level; the critical value is found once, by bisection."""
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, df) > level else (low, mid)
    return statistics.agg(F.count("*").alias("n"), F.avg((F.col(column) > high).cast("double")).alias("share"))


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """n and rho: correlation of average ranks."""
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())

    def rank(c: str) -> Column:
        w = Window.orderBy(c)
        return F.rank().over(w) + (F.count("*").over(Window.partitionBy(c)) - 1) / 2.0

    return both.select(rank(x).alias("rx"), rank(y).alias("ry")).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def decile_spread(rows: DataFrame, label: str = "size_decile", value: str = "ret") -> DataFrame:
    return welch(rows, label, value, 1, 10)


def variance_inflation(rows: DataFrame, design: list[str], dates: int = 20) -> DataFrame:
    """(factor, vif): mean over sampled dates of the factor's inflation against the others, without a constant."""
    from quantloom.operators.panel import every_kth_date

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf[design].dropna().to_numpy(float)
        if len(x) < len(design) + 5:
            return pd.DataFrame(columns=["date", "factor", "vif"])
        g = x.T @ x
        return pd.DataFrame({"date": pdf["date"].iloc[0], "factor": design, "vif": np.diag(np.linalg.pinv(g)) * np.diag(g)})

    each = every_kth_date(rows.select("date", *design), dates).groupBy("date").applyInPandas(fit, "date date, factor string, vif double")
    return each.groupBy("factor").agg(F.avg("vif").alias("vif"), F.count("*").alias("n_dates"))


def breusch_pagan(rows: DataFrame, design: list[str], value: str = "residual", dates: int = 20) -> DataFrame:
    """(date, n, lm, p): do squared residuals follow the exposures?"""
    from quantloom.operators.panel import every_kth_date

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna()
        n = len(pdf)
        if n <= len(design) + 1:
            return pd.DataFrame(columns=["date", "n", "lm", "p"])
        x = np.column_stack((np.ones(n), pdf[design].to_numpy(float)))
        u = pdf[value].to_numpy(float) ** 2
        rest = u - x @ np.linalg.lstsq(x, u, rcond=None)[0]
        total = ((u - u.mean()) ** 2).sum()
        lm = n * (1 - (rest**2).sum() / total) if total > 0 else 0.0
        return pd.DataFrame({"date": [pdf["date"].iloc[0]], "n": [n], "lm": [lm], "p": [chi2_tail(lm, x.shape[1] - 1)]})

    return every_kth_date(rows.select("date", value, *design), dates).groupBy("date").applyInPandas(fit, "date date, n long, lm double, p double")


def dickey_fuller(series: DataFrame, by: str = "factor", value: str = "ret", least: int = 20) -> DataFrame:
    """(by, n, lags, t, stationary): unit-root test with a constant, lags chosen by Akaike's criterion."""
    kind = series.schema[by].dataType.simpleString()

    def test(x: np.ndarray) -> tuple[int, float]:
        most = int(min(np.ceil(12 * (len(x) / 100) ** 0.25), len(x) // 2 - 2))
        d = np.diff(x)

        def design(p: int, start: int) -> tuple[np.ndarray, np.ndarray]:
            rows = np.arange(start, len(d))
            return np.column_stack([np.ones(len(rows)), x[rows], *[d[rows - k] for k in range(1, p + 1)]]), d[rows]

        def aic(p: int) -> float:
            a, y = design(p, most)
            e = y - a @ np.linalg.lstsq(a, y, rcond=None)[0]
            return len(y) * np.log(max(e @ e, 1e-300) / len(y)) + 2 * a.shape[1]

        best = min(range(most + 1), key=aic)
        a, y = design(best, best)
        b = np.linalg.lstsq(a, y, rcond=None)[0]
        e = y - a @ b
        cov = np.linalg.pinv(a.T @ a) * (e @ e) / max(1, len(y) - a.shape[1])
        return best, float(b[1] / np.sqrt(cov[1, 1]))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("date")[value].dropna().to_numpy(float)
        if len(x) < least:
            return pd.DataFrame(columns=[by, "n", "lags", "t", "stationary"])
        lags, t = test(x)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "n": [len(x)], "lags": [lags], "t": [t], "stationary": [t < adf_critical(len(x) - lags - 1)]})

    return series.select(by, "date", value).groupBy(by).applyInPandas(fit, f"{by} {kind}, n long, lags int, t double, stationary boolean")


def coverage(stats: DataFrame) -> DataFrame:
    return stats.groupBy("status").agg(F.count("*").alias("n_dates"))


# ---- portfolios ------------------------------------------------------------------------------------------------


def constraints(weights: DataFrame, leverage: float | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(portfolio, total, least, gross, verdict): weights sum to one, and none is negative or the gross is within bounds."""
    sums = weights.groupBy("portfolio").agg(F.sum("weight").alias("total"), F.min("weight").alias("least"), F.sum(F.abs("weight")).alias("gross"))
    ok = (F.abs(F.col("total") - 1) <= tolerance) & ((F.col("least") >= -tolerance) if leverage is None else (F.col("gross") <= leverage + tolerance))
    return sums.withColumn("verdict", F.when(ok, "PASS").otherwise("FAIL"))


def smallest_eigenvalue(cov: DataFrame) -> float:
    """Of a covariance (row, col, cov) of at most ``LARGEST`` names: a dense program of the driver's."""
    n = cov.select("row").distinct().count()
    if n > LARGEST:
        raise ValueError(f"{n} names; the least eigenvalue is computed for {LARGEST} at most")
    pdf = cov.toPandas()
    m = pdf.pivot(index="row", columns="col", values="cov").to_numpy(float)
    return float(np.linalg.eigvalsh((m + m.T) / 2).min())


def concentration_verdict(weights: DataFrame, warn: float = C.CONCENTRATION_WARN, fail: float = C.CONCENTRATION_FAIL) -> DataFrame:
    top = weights.groupBy("portfolio").agg(F.max(F.abs("weight")).alias("largest"))
    return top.withColumn("verdict", F.when(F.col("largest") > fail, "FAIL").when(F.col("largest") > warn, "WARN").otherwise("PASS"))


def variance_consistency(points: DataFrame, cov: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """(problem, point, reported, recomputed, verdict): w'Sw again, by joins, against the reported volatility."""
    w = points.select("problem", "point", "symbol", "weight", "volatility")
    other = w.select("problem", "point", F.col("symbol").alias("col"), F.col("weight").alias("z"))
    var = w.join(cov, w["symbol"] == cov["row"]).join(other, ["problem", "point", "col"]).groupBy("problem", "point").agg(F.sum(F.col("weight") * F.col("cov") * F.col("z")).alias("recomputed"), F.first(F.col("volatility") * F.col("volatility")).alias("reported"))
    return var.withColumn("verdict", F.when(F.abs(F.col("recomputed") - F.col("reported")) <= tolerance * F.greatest(F.abs("reported"), F.lit(1e-30)) + 1e-18, "PASS").otherwise("FAIL"))


def frontier_monotone(points: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """(problem, worst, verdict): along rising targets the volatility never falls."""
    one = points.where("converged").select("problem", "point", "volatility").distinct()
    step = one.withColumn("d", F.col("volatility") - F.lag("volatility").over(Window.partitionBy("problem").orderBy("point")))
    return step.groupBy("problem").agg(F.min("d").alias("worst")).withColumn("verdict", F.when(F.coalesce("worst", F.lit(0.0)) >= -tolerance, "PASS").otherwise("FAIL"))


def convergence(points: DataFrame) -> DataFrame:
    one = points.select("problem", "point", "converged").distinct()
    return one.groupBy("problem").agg(F.count("*").alias("n"), F.sum(F.col("converged").cast("int")).cast("long").alias("n_converged"))


def realized_volatility(predicted: DataFrame, realized: DataFrame, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """(portfolio, ratio, verdict): realized over predicted annual volatility."""
    both = predicted.select("portfolio", F.col("ann_vol").alias("p")).join(realized.select("portfolio", F.col("ann_vol").alias("r")), "portfolio")
    return both.withColumn("ratio", F.col("r") / F.when(F.col("p") > 0, F.col("p"))).withColumn("verdict", F.when(F.col("ratio").between(low, high), "PASS").otherwise("WARN")).select("portfolio", "ratio", "verdict")


def beta_neutrality(weights: DataFrame, betas: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(portfolio, beta, verdict): joined by symbol, so the order of rows cannot matter."""
    out = weights.join(betas, "symbol").groupBy("portfolio").agg(F.sum(F.col("weight") * F.col("beta")).alias("beta"))
    return out.withColumn("verdict", F.when(F.abs("beta") <= tolerance, "PASS").otherwise("FAIL"))


# ---- what plots are drawn from ---------------------------------------------------------------------------------


def histogram(values: DataFrame, value: str, bins: int = 200) -> DataFrame:
    """(bin, low, high, n, density): equal bins from the least to the greatest value, with the normal density of the same moments."""
    good = values.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    s = F.broadcast(good.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("m"), F.stddev_samp("v").alias("sd")))
    width = (F.col("hi") - F.col("lo")) / bins
    put = good.join(s, F.lit(True)).withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("lo")) / F.when(width > 0, width))).cast("int"))
    out = put.groupBy("bin").agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("m").alias("m"), F.first("sd").alias("sd"))
    low = F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins
    mid = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    z = (mid - F.col("m")) / F.col("sd")
    return out.select("bin", low.alias("low"), "n", (F.exp(-z * z / 2) / (F.col("sd") * (2 * np.pi) ** 0.5)).alias("density"))


def daily_alpha(residuals: DataFrame) -> DataFrame:
    """(date, alpha, cumulative): the mean residual of a date and its sum so far."""
    daily = residuals.groupBy("date").agg(F.avg("residual").alias("alpha"))
    return daily.withColumn("cumulative", F.sum("alpha").over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)))


def cumulative(series: DataFrame, by: str = "factor") -> DataFrame:
    w = Window.partitionBy(by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return series.where("ret IS NOT NULL").withColumn("cumulative", F.product(1 + F.col("ret")).over(w) - 1)


def rolling_r2(stats: DataFrame, n: int = 21, least: int = 5) -> DataFrame:
    w = Window.orderBy("date").rowsBetween(-(n - 1), 0)
    return stats.withColumn("r2_mean", F.when(F.count("r2").over(w) >= least, F.avg("r2").over(w)))
