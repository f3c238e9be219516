"""The engine's commands: from price files and statements to a risk model, portfolios and backtests.

Each command reads the tables that earlier ones wrote and writes its own under the output folder:

    python -m quantloom.plans.commands --data DIR --output DIR run-all
"""

from __future__ import annotations

import argparse
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions import constants as C
from quantloom.functions.solver import Limits
from quantloom.operators import asof as A
from quantloom.operators import backtest as T
from quantloom.operators import factors as X
from quantloom.operators import fundamentals as R
from quantloom.operators import inference as I
from quantloom.operators import panel as P
from quantloom.operators import portfolio as PF
from quantloom.operators import regression as G
from quantloom.operators import resolve as N
from quantloom.operators import risk as K
from quantloom.operators import standardize as S
from quantloom.operators import timing as M
from quantloom.operators import validation as V
from quantloom.sources import prices as PR
from quantloom.sources import sinks
from quantloom.sources import statements as ST
from quantloom.sources import universe as U


@dataclass
class Settings:
    """Where inputs are and the numbers of the model; the defaults are those of daily data."""

    data: str
    output: str
    mirror: str | None = None
    prices: str = "prices.parquet"
    volume: str = "volume.parquet"
    statements: str = "fundamentals"
    reference: str = "reference.xlsx"
    availability: str = "availability.csv"
    flags: str = "flags.csv"
    fetched: str = "fetched.parquet"
    macro: str = "macro.parquet"  # (name, date, price)
    macro_groups: str = "macro_groups.csv"  # name, symbol
    benchmark: str = "INDEX"
    industries: list[str] = field(default_factory=lambda: list(C.INDUSTRY_FACTORS))
    overrides: dict[str, str | None] = field(default_factory=dict)
    lookback: int = C.BETA_LOOKBACK_DAYS
    skip: int = C.MOMENTUM_LAG_DAYS
    least: int = C.MIN_N_PER_DAY
    top_n: int = C.TOP_N
    halflife: float = C.EWMA_HALFLIFE
    periods: dict[str, tuple[str, str]] = field(default_factory=lambda: dict(C.MODEL_PERIODS))
    start: str = "2021-01-01"
    points: int = C.FRONTIER_POINTS
    backtest_points: int = C.BACKTEST_FRONTIER_POINTS
    stock_cap: float = C.MAX_STOCK_WEIGHT
    industry_cap: float | None = C.MAX_INDUSTRY_WEIGHT
    rest_cap: float | None = None
    group_cap: float = C.GROUP_MAX_WEIGHT
    group_penalty: float = C.GROUP_SOFT_PENALTY
    macro_timing: bool = False
    leverage: float | None = None
    force: bool = False

    def at(self, name: str) -> str:
        return f"{self.data.rstrip('/')}/{name}"

    @property
    def design(self) -> list[str]:
        return [*self.industries, *C.STYLE_FACTORS, *C.INDICATOR_FACTORS]

    @property
    def segment_design(self) -> list[str]:
        return [c for c in self.design if c != "top100_flag"]

    def design_of(self, scope: tuple[str, ...]) -> list[str]:
        return self.segment_design if scope and scope[0] == "segments" else self.design


class Commands:
    def __init__(self, spark: SparkSession, settings: Settings) -> None:
        self.spark, self.s = spark, settings
        self.paths = sinks.OutputPaths(settings.output, settings.mirror)

    # ---- artifacts ---------------------------------------------------------------------------------------------

    def has(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.at(name))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def price_rows(self, symbols: list[str] | None = None) -> DataFrame:
        """(date, symbol, price): as refreshed last, or else as delivered."""
        if not self.has("prices_refreshed"):
            return PR.load_prices(self.spark, self.s.at(self.s.prices), symbols)
        rows = self.load("prices_refreshed")
        return rows.where(F.col("symbol").isin(symbols)) if symbols is not None else rows

    def benchmark_rows(self) -> DataFrame:
        """(date, market_ret)."""
        s = self.s
        if self.has("prices_refreshed"):
            px = self.load("prices_refreshed").where(F.col("symbol") == s.benchmark)
        else:
            px = PR.load_wide(self.spark, s.at(s.prices), [s.benchmark])[0].withColumnRenamed("value", "price")
        return PR.benchmark_returns_view(px, s.benchmark).select("date", "market_ret")

    def save(self, df: DataFrame, name: str, *scope: str) -> DataFrame:
        paths = self.paths.scoped(*scope)
        sinks.save(df, paths, name)
        return self.spark.read.parquet(paths.at(name))

    def load(self, name: str, *scope: str) -> DataFrame:
        return self.spark.read.parquet(self.paths.scoped(*scope).at(name))

    def write_text(self, text: str, name: str, *scope: str) -> str:
        where = self.paths.scoped(*scope).at(name)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(where)
        return text

    # ---- model -------------------------------------------------------------------------------------------------

    def build_universe(self) -> DataFrame:
        s = self.s
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(s.at(s.statements))
        stamped = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("modificationTime").cast("double").alias("mtime"))
        names = ST.scan_statements(self.spark, s.at(s.statements)).groupBy("file").agg(F.max("company_name").alias("company_name"))
        reference = U.reference_companies(self.spark, s.at(s.reference))
        # names in file names are escaped in paths
        listed = stamped.withColumn("file", F.url_decode(F.regexp_replace("file", r"\+", "%2B"))).join(names.withColumn("file", F.url_decode(F.regexp_replace("file", r"\+", "%2B"))), "file", "left")
        mapping = N.universe_mapping(listed, reference, U.overrides(self.spark, s.overrides) if s.overrides else self.spark.createDataFrame([], "dedup_key string, symbol string"), U.priced_symbols(self.spark, s.at(s.availability)))
        return self.save(mapping, "universe")

    def build_fundamentals(self) -> DataFrame:
        files = self.load("universe").where("included").select("file", "symbol")
        items = ST.scan_statements(self.spark, self.s.at(self.s.statements)).withColumn("file", F.url_decode(F.regexp_replace("file", r"\+", "%2B")))
        self.save(ST.quarterly_table(items, files), "fundamentals_quarterly")
        return self.save(R.annual_ratios(ST.annual_table(items, files)), "fundamentals_annual")

    def universe(self) -> DataFrame:
        return N.locked_universe(self.load("universe"))

    def build_factors(self) -> DataFrame:
        s, universe = self.s, self.universe()
        symbols = [r["symbol"] for r in universe.orderBy("symbol").collect()]
        px = self.price_rows(symbols)
        market = F.broadcast(self.benchmark_rows())
        rows = P.with_returns(P.full_grid(px)).join(market, "date", "left").join(PR.load_volume(self.spark, s.at(s.volume), symbols), ["date", "symbol"], "left")
        events = A.visible_from(self.load("fundamentals_annual"))
        self.save(A.as_of_join(rows.select("date", "symbol"), events, ["eps"]), "point_in_time")
        rows = A.as_of_join(rows, events, ["shares", "leverage", "roa", "roe", "net_margin", "eps", "bvps", "dps", "capex", "revenue_growth"])
        rows = X.momentum(X.rolling_beta(rows, n=s.lookback), lookback=s.lookback, skip=s.skip)
        rows = X.liquidity(X.holiday_filled(rows), n=s.lookback)
        rows = rows.withColumn("market_cap", F.col("price") * F.col("shares")).withColumn("size", X.log_size())
        rows = X.top_flag(X.size_decile(X.quality_composite(X.value_composite(rows))), n=s.top_n)
        rows = rows.withColumnsRenamed({"net_margin": "profitability", "revenue_growth": "growth"})
        rows = S.winsor_zscore(rows, *C.STYLE_FACTORS)
        weights = U.industry_weights(self.spark, s.at(s.reference), universe, s.industries)
        flags = U.static_flags(self.spark, s.at(s.flags), universe).withColumnRenamed("flag", "psu_flag")
        rows = X.static_attributes(X.static_attributes(rows, F.broadcast(weights)), F.broadcast(flags), {"psu_flag": 0})
        out = self.save(rows.select("date", "symbol", *s.design, "size_decile", "market_cap", "ret"), "exposures")
        return out

    def fit(self, exposures: DataFrame, design: list[str], *scope: str) -> dict[str, DataFrame]:
        # each symbol's own return of the next date of this panel's calendar
        aligned = G.aligned(exposures.drop("ret"), self.load("exposures").select("date", "symbol", "ret"))
        clean, flagged = G.split_outliers(aligned)
        fits = self.save(G.cross_sectional_fits(G.complete_cases(clean, design), design, least=self.s.least), "fits", *scope)
        tables = G.regression_tables(fits, flagged.select("target_date", "symbol", "raw_return"))
        summary = I.summary(tables["factor_returns"])
        sinks.save_regression(tables, summary, self.paths.scoped(*scope))
        return tables | {"summary": summary}

    def run_regression(self) -> dict[str, DataFrame]:
        return self.fit(self.load("exposures"), self.s.design)

    def run_risk(self, *scope: str) -> tuple[DataFrame, DataFrame]:
        cov = K.ewma_covariance(self.load("factor_returns", *scope).select("date", "factor", "ret"), halflife=self.s.halflife)
        spec = K.ewma_specific_risk(self.load("residuals_long", *scope), halflife=self.s.halflife)
        return self.save(cov, "factor_covariance", *scope), self.save(spec, "specific_risk", *scope)

    def verdicts(self, *scope: str) -> DataFrame:
        fits, residuals = self.load("fits", *scope), self.load("residuals_long", *scope)
        returns = self.load("factor_returns", *scope).select("date", "factor", "ret")
        exposures = self.load("exposures")
        stats = G.fit_statistics(fits)
        alpha = V.residual_alpha(residuals)
        held = residuals.join(exposures.select("date", "symbol", "top100_flag", *self.s.design_of(scope)), ["date", "symbol"])
        named = held.where("top100_flag IS NOT NULL").withColumn("segment", F.when(F.col("top100_flag") == 1, "top100").otherwise("rest"))
        by_segment = V.residual_alpha(named, ["segment"]).agg(F.count("*").alias("n"), F.max(F.abs("nw_t")).alias("t"))
        uneven = V.breusch_pagan(held, self.s.design_of(scope)).agg(F.count("*").alias("n"), F.avg((F.col("p") < 0.05).cast("double")).alias("share"))
        early = V.look_ahead(self.load("point_in_time"), A.visible_from(self.load("fundamentals_annual")), "eps").agg(F.count("*").cast("double").alias("bad"))
        parts = [
            V.verdict(V.r2_distribution(stats), "r2", F.col("mean"), "-", F.lit(False), F.format_string("median %.4f of %d dates", "median", "n"), "INFO"),
            V.verdict(V.significant_factors(I.summary(returns)), "significant factors", F.col("n_significant").cast("double"), "|t| > 2", F.lit(False), F.format_string("of %d", "n"), "INFO"),
            V.verdict(V.jarque_bera(residuals, "residual"), "normal residuals", F.col("jb"), "p > 0.05", F.col("p") > 0.05, F.format_string("p %.4f", "p"), "WARN"),
            V.verdict(alpha, "residual alpha", F.col("nw_t"), "|t| < 2", F.col("verdict") == "PASS", F.format_string("%d dates", "n")),
            V.verdict(by_segment, "residual alpha by segment", F.coalesce("t", F.lit(0.0)), "|t| < 2", F.coalesce("t", F.lit(0.0)) <= 2, F.format_string("largest of %d segments", "n")),
            V.verdict(uneven, "even residual variance", F.coalesce("share", F.lit(0.0)), "<= 0.5", F.coalesce("share", F.lit(0.0)) <= 0.5, F.format_string("share of %d dates that reject it", "n"), "WARN"),
            V.verdict(early, "no look-ahead", F.col("bad"), "0", F.col("bad") == 0, F.lit("rows that show a report too early")),
            V.verdict(V.chi2_share(V.ljung_box(residuals), "q", 5), "autocorrelation", F.coalesce("share", F.lit(0.0)), "<= 0.5", F.coalesce("share", F.lit(0.0)) <= 0.5, F.format_string("%d symbols", "n"), "WARN"),
            V.verdict(V.dickey_fuller(returns).agg(F.count("*").alias("n"), F.avg(F.col("stationary").cast("double")).alias("share")), "stationary factors", F.coalesce("share", F.lit(0.0)), "all", F.coalesce("share", F.lit(0.0)) >= 1, F.format_string("%d factors", "n"), "WARN"),
            V.verdict(V.industry_sums(exposures, self.s.industries).agg(F.count("*").cast("double").alias("bad")), "industry weights", F.col("bad"), "0", F.col("bad") == 0, F.lit("rows that do not sum to one")),
            V.verdict(V.decile_spread(exposures), "size spread", F.coalesce("t", F.lit(0.0)), "-", F.lit(False), F.lit("largest against smallest"), "INFO"),
            V.verdict(V.variance_inflation(exposures, self.s.design_of(scope)).agg(F.max("vif").alias("vif")), "inflation", F.coalesce("vif", F.lit(0.0)), "<= 10", F.coalesce("vif", F.lit(0.0)) <= 10, F.lit("largest mean over dates"), "WARN"),
            V.verdict(V.coverage(stats).agg(F.sum(F.when(F.col("status") == "fitted", F.col("n_dates")).otherwise(0)).cast("double").alias("fitted")), "coverage", F.col("fitted"), "-", F.lit(False), F.lit("dates fitted"), "INFO"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def validate(self, *scope: str) -> DataFrame:
        out = self.save(self.verdicts(*scope), "validation", *scope)
        self.model_plots(*scope)
        self.write_text(sinks.report("Model checks", out), "validation_report", *scope)
        return out

    def model_plots(self, *scope: str) -> None:
        """What the plots of a fitted model are drawn from, one table a plot."""
        returns = self.load("factor_returns", *scope).select("date", "factor", "ret")
        residuals, exposures = self.load("residuals_long", *scope), self.load("exposures")
        tables = {
            "plot_cumulative": V.cumulative(returns),
            "plot_significance": I.summary(returns).select("factor", "nw_t", (F.abs("nw_t") > 2).alias("significant")),
            "plot_r2": V.rolling_r2(G.fit_statistics(self.load("fits", *scope))).select("date", "r2", "r2_mean"),
            "plot_correlation": K.correlations(K.ewma_covariance(returns, halflife=self.s.halflife)),
            "plot_vif": V.variance_inflation(exposures, self.s.design_of(scope)),
            "plot_residuals": V.histogram(residuals, "residual"),
            "plot_daily_alpha": V.daily_alpha(residuals),
            "plot_deciles": X.decile_means(exposures),
        }
        for name, df in tables.items():
            self.save(df, name, *scope)

    def refresh_prices(self) -> DataFrame:
        """Fetched rows (date, symbol, price) replace stored ones of the same date and symbol; later commands read the result.

        Prices that already run to yesterday are left as they are, unless ``force`` is set.
        """
        s = self.s
        old = PR.load_prices(self.spark, s.at(s.prices))
        current = old.agg((F.max("date") >= F.date_sub(F.current_date(), 1)).alias("now")).first()["now"]
        if current and not s.force:
            return self.price_rows()
        return self.save(PR.refreshed(old, self.spark.read.parquet(s.at(s.fetched))), "prices_refreshed")

    def run_all(self) -> DataFrame:
        self.build_universe()
        self.build_fundamentals()
        self.build_factors()
        self.run_regression()
        self.run_risk()
        return self.validate()

    def run_periods(self) -> dict[str, dict]:
        panel = self.load("exposures")
        out = {}
        for name, (a, b) in self.s.periods.items():
            part = P.date_range(panel, a, b)
            if part.limit(1).count():
                out[name] = self.fit(part, self.s.design, "periods", name)
        return out

    def run_segments(self) -> dict[str, dict]:
        panel, out = self.load("exposures"), {}
        for name, flag in C.SEGMENTS.items():
            out[name] = self.fit(panel.where(F.col("top100_flag") == flag), self.s.segment_design, "segments", name)
            self.run_risk("segments", name)
        return out

    # ---- portfolios --------------------------------------------------------------------------------------------

    def scope(self, base: str) -> tuple[str, ...]:
        s = self.s
        extra = sinks.experiment_scope(s.rest_cap, s.industry_cap is not None, s.group_cap if base.endswith("segments") and s.group_cap != C.GROUP_MAX_WEIGHT else None, s.macro_timing, s.leverage)
        return (base, extra) if extra else (base,)

    def tilted(self, mu: DataFrame) -> DataFrame:
        s = self.s
        if not s.macro_timing:
            return mu
        groups = self.spark.read.csv(s.at(s.macro_groups), header=True)
        tilt = M.macro_tilt(self.load("exposures").select("date", "symbol", "ret"), groups, self.spark.read.parquet(s.at(s.macro)))
        return mu.join(tilt, "symbol", "left").select("symbol", (F.col("mu") + F.coalesce("tilt", F.lit(0.0))).alias("mu"))

    def limits(self, exposures: DataFrame, segments: DataFrame | None = None):
        """A function of the symbols: caps, industries and, for the joint model, segments. A few hundred names at most."""
        s = self.s
        sectors = {r["symbol"]: [r[c] or 0.0 for c in s.industries] for r in exposures.select("symbol", *s.industries).collect()}
        rest = {r["symbol"] for r in segments.where("segment = 'rest'").collect()} if segments is not None else set()

        def of(symbols: list[str]) -> Limits:
            n = len(symbols)
            cap = max(s.stock_cap, 1.5 / n)
            member = np.array([x in rest for x in symbols], float)
            caps = np.where(member > 0, s.rest_cap if s.rest_cap is not None else cap, cap) if rest else cap
            groups = np.array([sectors[x] for x in symbols]) if s.industry_cap is not None else None
            lim = Limits(cap=caps, soft=True, penalty=C.STOCK_SOFT_PENALTY, groups=groups, group_cap=s.industry_cap or 1.0, leverage=s.leverage)
            if rest:
                lim.soft_group, lim.soft_group_cap, lim.soft_group_penalty = member, s.group_cap, s.group_penalty
            return lim

        return of

    def _optimize(self, x: DataFrame, cov: DataFrame, spec: DataFrame, mu: DataFrame, lim, base: str) -> DataFrame:
        scope = self.scope(base)
        stock_cov = self.save(K.stock_covariance(x, cov, spec), "stock_covariance", *scope)
        mu = self.save(self.tilted(mu), "expected_stock_returns", *scope)
        points = self.save(PF.frontiers(PF.problem_rows(stock_cov, mu), self.s.points, lim), "frontier", *scope)
        named = [(PF.global_minimum(points), "GMV"), (PF.max_sharpe(points), "Max-Sharpe")]
        weights = PF.equal_weights(spec.join(mu, "symbol", "left_semi").select("symbol"))
        for df, name in named:
            weights = weights.unionByName(df.select(F.lit(name).alias("portfolio"), "symbol", "weight"))
        weights = self.save(weights, "weights", *scope)
        risk = PF.risk_decomposition(weights, x, cov, spec)
        self.save(PF.factor_exposure(weights, x), "factor_exposure", *scope)
        self.save(PF.comparison(risk, PF.concentration(weights), mu, weights), "comparison", *scope)
        return weights

    def optimize_portfolio(self) -> DataFrame:
        returns = self.load("factor_returns").select("date", "factor", "ret")
        expected = self.save(K.expected_factor_returns(I.summary(returns), K.ewma_mean(returns, halflife=self.s.halflife)), "expected_factor_returns", *self.scope("portfolio"))
        now = P.latest(self.load("exposures"), self.s.design)
        x = K.long_exposures(now, self.s.design)
        return self._optimize(x, self.load("factor_covariance"), self.load("specific_risk"), K.projected_returns(x, expected), self.limits(now), "portfolio")

    def joint(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
        """Exposures, covariance, specific risk, expected returns and members of the two-segment model."""
        s = self.s
        now = P.latest(self.load("exposures"), s.segment_design).where("top100_flag IS NOT NULL").withColumn("segment", F.when(F.col("top100_flag") == 1, "top100").otherwise("rest"))
        members = now.select("symbol", "segment")
        wide = PF.joint_exposures(now, s.segment_design, list(C.SEGMENTS))
        x = K.long_exposures(wide, PF.joint_columns(s.segment_design, list(C.SEGMENTS))).where("x <> 0")
        series = {k: self.load("factor_returns", "segments", k).select("date", "factor", "ret") for k in C.SEGMENTS}
        cov = K.ewma_covariance(PF.joint_factor_returns(series), halflife=s.halflife)
        spec = PF.joint_specific_risk({k: self.load("specific_risk", "segments", k) for k in C.SEGMENTS}, members)
        expected = None
        for k, df in series.items():
            part = K.expected_factor_returns(I.summary(df), K.ewma_mean(df, halflife=s.halflife)).withColumn("factor", F.concat("factor", F.lit(f"__{k}")))
            expected = part if expected is None else expected.unionByName(part)
        return x, cov, spec, K.projected_returns(x, expected), now

    def optimize_portfolio_segments(self) -> DataFrame:
        x, cov, spec, mu, now = self.joint()
        scope = self.scope("portfolio_segments")
        cov, spec = self.save(cov, "factor_covariance", *scope), self.save(spec, "specific_risk", *scope)
        return self._optimize(x, cov, spec, mu, self.limits(now, now.select("symbol", "segment")), "portfolio_segments")

    def validate_portfolio(self, base: str = "portfolio") -> DataFrame:
        scope = self.scope(base)
        points, cov, weights = self.load("frontier", *scope), self.load("stock_covariance", *scope), self.load("weights", *scope)
        monotone, converged = V.frontier_monotone(points), V.convergence(points)
        least = V.smallest_eigenvalue(cov)
        consistent = V.variance_consistency(points, cov).agg(F.max(F.abs(F.col("recomputed") - F.col("reported"))).alias("gap"), F.sum((F.col("verdict") == "FAIL").cast("int")).alias("bad"))
        held = self.load("exposures").select("date", "symbol", "ret")
        realized = held.where("ret IS NOT NULL").groupBy("symbol").agg(F.avg("ret").alias("m"))
        rank = V.spearman(self.load("expected_stock_returns", *scope).join(realized, "symbol"), "mu", "m")
        vol = V.realized_volatility(self.load("comparison", *scope), PF.performance(PF.return_series(weights, P.last_dates(held, C.TRADING_DAYS_PER_YEAR))))
        text = lambda c: F.lit(c)
        betas = P.latest(self.load("exposures"), ["beta"]).select("symbol", "beta")
        neutral = V.beta_neutrality(weights.where("portfolio = 'Beta-Neutral'"), betas).agg(F.max(F.abs("beta")).alias("beta"))
        parts = [
            V.verdict(V.constraints(weights, self.s.leverage), "constraints", F.col("total"), "1", F.col("verdict") == "PASS", F.col("portfolio")),
            V.verdict(self.spark.range(1).select(F.lit(least).alias("e")), "positive covariance", F.col("e"), ">= -1e-8", F.col("e") >= -1e-8, text("least eigenvalue")),
            V.verdict(converged, "convergence", F.col("n_converged").cast("double"), "all", F.col("n") == F.col("n_converged"), F.format_string("of %d points", "n"), "WARN"),
            V.verdict(consistent, "variance", F.col("gap"), "1e-10 of it", F.col("bad") == 0, text("largest gap")),
            V.verdict(V.concentration_verdict(weights), "concentration", F.col("largest"), "<= 0.1", F.col("verdict") == "PASS", F.col("portfolio"), "WARN"),
            V.verdict(monotone, "monotone frontier", F.coalesce("worst", F.lit(0.0)), ">= 0", F.col("verdict") == "PASS", text("least step of volatility")),
            V.verdict(vol, "realized volatility", F.coalesce("ratio", F.lit(0.0)), "0.5 to 2", F.col("verdict") == "PASS", F.col("portfolio"), "WARN"),
            V.verdict(neutral, "beta neutrality", F.coalesce("beta", F.lit(0.0)), "1e-6", F.coalesce("beta", F.lit(0.0)) <= 1e-6, F.when(F.col("beta").isNull(), "no such portfolio").otherwise("net beta")),
            V.verdict(rank, "expected and realized", F.coalesce("rho", F.lit(0.0)), "> 0", F.coalesce("rho", F.lit(0.0)) > 0, F.format_string("%d symbols", "n"), "WARN"),
        ]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        out = self.save(out, "portfolio_validation", *scope)
        self.portfolio_plots(base, realized)
        self.write_text(sinks.report("Portfolio checks", out, {"Comparison": self.load("comparison", *scope)}), "portfolio_report", *scope)
        return out

    def portfolio_plots(self, base: str, realized: DataFrame) -> None:
        """What the plots of portfolios are drawn from, one table a plot."""
        scope = self.scope(base)
        weights, tilts = self.load("weights", *scope), self.load("factor_exposure", *scope)
        sectors = K.long_exposures(P.latest(self.load("exposures"), self.s.industries), self.s.industries)
        equal = tilts.where("portfolio = 'Equal-Weight'").select("factor", F.col("exposure").alias("equal"))
        held = P.last_dates(self.load("exposures").select("date", "symbol", "ret"), C.TRADING_DAYS_PER_YEAR)
        compared = self.load("comparison", *scope)
        tables = {
            "plot_frontier": self.load("frontier", *scope).select("point", "volatility", "expected_return", "converged").distinct(),
            "plot_weights": PF.top_holdings(weights, 20),
            "plot_tilts": tilts.join(equal, "factor", "left").withColumn("tilt", F.col("exposure") - F.col("equal")),
            "plot_sectors": PF.sector_weights(weights, sectors),
            "plot_metrics": compared.select("portfolio", "ann_return", "ann_vol", "sharpe", "effective_n"),
            "plot_risk": compared.select("portfolio", "factor_pct", "specific_pct"),
            "plot_static": PF.drawdowns(PF.return_series(weights, held)),
            "plot_expected": self.load("expected_stock_returns", *scope).join(realized, "symbol"),
        }
        for name, df in tables.items():
            self.save(df, name, *scope)

    def validate_portfolio_segments(self) -> DataFrame:
        return self.validate_portfolio("portfolio_segments")

    def day_limits(self, design: list[str]):
        """A function of a rebalance's rows: caps, industries as of that date and, where there are segments, who is in the rest."""
        s = self.s
        at = [[design.index(n) for n in (c, *(f"{c}__{k}" for k in C.SEGMENTS)) if n in design] for c in s.industries]

        def of(pdf) -> Limits:
            x = np.array(pdf["x"].tolist(), float)
            cap = max(s.stock_cap, 1.5 / len(pdf))
            rest = (pdf["segment"] == "rest").to_numpy(float) if "segment" in pdf else np.zeros(len(pdf))
            caps = np.where(rest > 0, s.rest_cap if s.rest_cap is not None else cap, cap) if rest.any() else cap
            groups = np.stack([x[:, k].sum(axis=1) for k in at], axis=1) if s.industry_cap is not None else None
            lim = Limits(cap=caps, soft=True, penalty=C.STOCK_SOFT_PENALTY, groups=groups, group_cap=s.industry_cap or 1.0, leverage=s.leverage)
            if rest.any():
                lim.soft_group, lim.soft_group_cap, lim.soft_group_penalty = rest, s.group_cap, s.group_penalty
            return lim

        return of

    def rebalances(self) -> DataFrame:
        """(as_of, until): those with a date to hold to."""
        return T.rebalance_dates(P.calendar(self.load("exposures")), self.s.start).where("until IS NOT NULL")

    def tilts(self, dates: DataFrame) -> DataFrame | None:
        s = self.s
        if not s.macro_timing:
            return None
        groups = self.spark.read.csv(s.at(s.macro_groups), header=True)
        return M.macro_tilts(self.load("exposures").select("date", "symbol", "ret"), groups, self.spark.read.parquet(s.at(s.macro)), dates)

    def _backtest(self, rows: DataFrame, design: list[str], dates: DataFrame, base: str) -> DataFrame:
        s, scope = self.s, (*self.scope(base), "backtest")
        panel = self.load("exposures").select("date", "symbol", "ret")
        weights = self.save(T.walk_forward(rows, s.backtest_points, self.day_limits(design)), "weights", *scope)
        series = self.save(T.held_returns(weights, dates, panel), "returns", *scope)
        turns = self.save(T.turnover(weights), "turnover", *scope)
        bench = self.benchmark_rows().withColumnRenamed("market_ret", "bench")
        metrics = self.save(PF.performance(series, turnover=turns), "metrics", *scope)
        relative = self.save(PF.benchmark_relative(series, bench), "relative", *scope)
        self.save(PF.drawdowns(series), "plot_drawdowns", *scope)
        self.save(series.join(bench, "date"), "plot_benchmark", *scope)
        self.save(turns, "plot_turnover", *scope)
        checks = V.constraints(weights.withColumn("portfolio", F.concat_ws(" ", "portfolio", F.col("as_of").cast("string"))), s.leverage).groupBy("verdict").agg(F.count("*").alias("n"))
        self.write_text(sinks.report("Backtest", checks, {"Performance": metrics, "Against the benchmark": relative}), "backtest_report", *scope)
        return metrics

    def backtest_portfolio(self) -> DataFrame:
        s, dates = self.s, self.rebalances()
        cov, expected = T.factor_models(self.load("factor_returns"), dates, s.halflife)
        risk = T.specific_as_of(self.load("residuals_long"), dates, s.halflife)
        x = T.latest_as_of(self.load("exposures"), dates, s.design)
        return self._backtest(T.problems(x, s.design, cov, expected, risk, tilts=self.tilts(dates)), s.design, dates, "portfolio")

    def backtest_portfolio_segments(self) -> DataFrame:
        s, dates = self.s, self.rebalances()
        rows = self.load("exposures").withColumn("segment", F.when(F.col("top100_flag") == 1, "top100").when(F.col("top100_flag") == 0, "rest"))
        series = {k: self.load("factor_returns", "segments", k) for k in C.SEGMENTS}
        residuals = {k: self.load("residuals_long", "segments", k) for k in C.SEGMENTS}
        design = s.segment_design
        problems = T.joint_problems(rows, design, series, residuals, dates, s.halflife, tilts=self.tilts(dates))
        return self._backtest(problems, PF.joint_columns(design, list(C.SEGMENTS)), dates, "portfolio_segments")


NAMES = ["build-universe", "build-fundamentals", "build-factors", "run-regression", "run-risk", "validate", "refresh-prices", "run-all", "run-periods", "run-segments", "optimize-portfolio", "validate-portfolio", "backtest-portfolio", "optimize-portfolio-segments", "validate-portfolio-segments", "backtest-portfolio-segments"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=NAMES)
    p.add_argument("--data", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--mirror")
    p.add_argument("--start", default="2021-01-01")
    p.add_argument("--force", action="store_true", help="refresh prices that already run to yesterday")
    p.add_argument("--macro-timing", action="store_true")
    p.add_argument("--long-short", action="store_true")
    p.add_argument("--max-leverage", type=float, default=C.MAX_LEVERAGE)
    p.add_argument("--rest-max-stock-weight", type=float)
    p.add_argument("--no-industry-cap", action="store_true")
    p.add_argument("--rest-segment-max-weight", type=float, default=C.GROUP_MAX_WEIGHT)
    p.add_argument("--rest-segment-weight-penalty", type=float, default=C.GROUP_SOFT_PENALTY)
    return p


def settings_of(a: argparse.Namespace) -> Settings:
    return Settings(data=a.data, output=a.output, mirror=a.mirror, start=a.start, force=a.force, macro_timing=a.macro_timing, leverage=a.max_leverage if a.long_short else None, rest_cap=a.rest_max_stock_weight, industry_cap=None if a.no_industry_cap else C.MAX_INDUSTRY_WEIGHT, group_cap=a.rest_segment_max_weight, group_penalty=a.rest_segment_weight_penalty)


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("quantloom").getOrCreate()
    getattr(Commands(spark, settings_of(a)), a.command.replace("-", "_"))()


if __name__ == "__main__":
    main()
