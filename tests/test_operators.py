"""Operators against hand-computed values, closed forms and recovered parameters."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import solver, special
from quantloom.operators import asof, backtest, factors, fundamentals, inference, panel, portfolio, regression, resolve, risk, standardize, timing, validation

D0 = dt.date(2024, 1, 1)


def day(k):
    return D0 + dt.timedelta(days=k)


def rows(df, *cols, by=None):
    return [tuple(r) for r in df.orderBy(*(by or cols[:1])).select(*cols).collect()]


def long(spark, values, name="v"):
    return spark.createDataFrame([(day(0), f"s{i:03d}", None if v is None else float(v)) for i, v in enumerate(values)], f"date date, symbol string, {name} double")


class TestStandardize:
    def test_moments(self, spark):
        got = [r[1] for r in rows(standardize.zscore(long(spark, [1.0, 2, 3, 4, 5]), "v"), "symbol", "v")]
        assert math.isclose(np.mean(got), 0, abs_tol=1e-12) and math.isclose(np.std(got, ddof=1), 1)

    def test_null_passes_and_flat_is_null(self, spark):
        got = [r[1] for r in rows(standardize.zscore(long(spark, [1.0, None, 3, None, 5]), "v"), "symbol", "v")]
        assert [g is None for g in got] == [False, True, False, True, False]
        assert all(r[1] is None for r in rows(standardize.zscore(long(spark, [5.0, 5, 5]), "v"), "symbol", "v"))
        assert all(r[1] is None for r in rows(standardize.zscore(long(spark, [5.0, None]), "v"), "symbol", "v"))

    def test_winsorize(self, spark):
        values = [float(x) for x in range(1, 101)] + [10000.0]
        got = [r[1] for r in rows(standardize.winsorize(long(spark, values), "v"), "symbol", "v")]
        assert max(got) == pytest.approx(np.quantile(values, 0.99)) and min(got) == pytest.approx(np.quantile(values, 0.01))
        got = [r[1] for r in rows(standardize.winsorize(long(spark, [1.0, 2, 3, 4, 1000]), "v", bounds=(-1, 1), method="std"), "symbol", "v")]
        assert max(got) == pytest.approx(202 + np.std([1, 2, 3, 4, 1000], ddof=1))
        with pytest.raises(ValueError):
            standardize.winsorize(long(spark, [1.0]), "v", method="other")

    def test_each_date_alone(self, spark):
        data = [(day(k), s, v * 10**k) for k in (0, 1) for s, v in (("a", 1.0), ("b", 2.0), ("c", 4.0))]
        got = rows(standardize.winsor_zscore(spark.createDataFrame(data, "date date, symbol string, v double"), "v"), "date", "symbol", "v", by=["date", "symbol"])
        assert [round(r[2], 10) for r in got[:3]] == [round(r[2], 10) for r in got[3:]]


class TestPanel:
    def test_returns_pad_gaps(self, spark):
        df = spark.createDataFrame([(day(0), "a", 100.0), (day(1), "a", None), (day(2), "a", 110.0)], "date date, symbol string, price double")
        assert [r[1] for r in rows(panel.with_returns(df), "date", "ret")] == [None, 0.0, pytest.approx(0.1)]
        assert [r[1] for r in rows(panel.with_returns(df, fill=False), "date", "ret")] == [None, None, None]
        zero = spark.createDataFrame([(day(0), "a", 0.0), (day(1), "a", 1.0)], "date date, symbol string, price double")
        assert [r[1] for r in rows(panel.with_returns(zero), "date", "ret")] == [None, None]

    def test_grid_melt_pivot(self, spark):
        df = spark.createDataFrame([(day(0), "a", 1.0), (day(1), "b", 2.0)], "date date, symbol string, value double")
        assert panel.full_grid(df).count() == 4
        wide = panel.pivot(df, "value", ["a", "b"])
        assert rows(panel.melt(wide).where("value is not null"), "date", "symbol", "value") == [(day(0), "a", 1.0), (day(1), "b", 2.0)]

    def test_upsert_and_dates(self, spark):
        old = spark.createDataFrame([(day(0), "a", 1.0), (day(1), "a", 2.0)], "date date, symbol string, v double")
        new = spark.createDataFrame([(day(1), "a", 9.0), (day(40), "a", 3.0)], "date date, symbol string, v double")
        got = panel.upsert(old, new, ["date", "symbol"])
        assert rows(got, "date", "v") == [(day(0), 1.0), (day(1), 9.0), (day(40), 3.0)]
        assert rows(panel.month_end_dates(panel.calendar(got)), "date") == [(day(1),), (day(40),)]
        assert rows(panel.next_date(panel.calendar(got)), "date", "target_date") == [(day(0), day(1)), (day(1), day(40))]
        assert panel.every_kth_date(got, 2).count() == 2 and panel.last_dates(got, 1).count() == 1

    def test_nan_is_missing(self, spark):
        df = spark.createDataFrame([(1, float("nan")), (2, 1.0)], "k int, v double")
        assert rows(panel.missing_as_null(df, "v"), "k", "v") == [(1, None), (2, 1.0)]


class TestAsOf:
    def test_lag_and_carry(self, spark):
        events = spark.createDataFrame([("a", dt.date(2023, 3, 31), 0.1), ("a", dt.date(2024, 3, 31), 0.2), ("a", dt.date(2024, 9, 30), None)], "symbol string, fiscal_year_end date, v double")
        days = [dt.date(2023, 5, 25), dt.date(2023, 5, 30), dt.date(2024, 5, 29), dt.date(2024, 6, 3), dt.date(2026, 1, 1)]
        grid = spark.createDataFrame([(d, "a") for d in days] + [(days[0], "zzz")], "date date, symbol string")
        got = asof.as_of_join(grid, asof.visible_from(events), ["v"])
        assert [r[1] for r in rows(got.where("symbol = 'a'"), "date", "v")] == [None, 0.1, 0.1, 0.2, 0.2]
        assert rows(got.where("symbol = 'zzz'"), "date", "v") == [(days[0], None)]
        assert asof.as_of_join(grid, asof.visible_from(events).limit(0), ["v"]).where("v is not null").count() == 0


class TestFundamentals:
    COLUMNS = "symbol string, fiscal_year_end date, sales double, net_profit double, total_assets double, share_capital double, reserves double, borrowings double, net_block double, depreciation double, cfo double, shares double, dividend double"

    def table(self, spark, ends=(2022, 2023, 2024), **change):
        data = []
        for k, y in enumerate(ends):
            r = {"sales": 1000.0 * (k + 1), "net_profit": 100.0, "total_assets": 2000.0, "share_capital": 100.0, "reserves": 400.0, "borrowings": 250.0, "net_block": 500.0 + 50 * k, "depreciation": 20.0, "cfo": 60.0, "shares": 1e7, "dividend": 30.0} | change
            data.append(("A", dt.date(y, 3, 31), *r.values()))
        return spark.createDataFrame(data, self.COLUMNS)

    def test_formulas(self, spark):
        r = fundamentals.annual_ratios(self.table(spark)).orderBy("fiscal_year_end").collect()
        first, second = r[0], r[1]
        assert (first["leverage"], first["roa"], first["roe"], first["net_margin"]) == (0.5, 0.05, 0.2, 0.1)
        assert (first["eps"], first["bvps"], first["dps"], first["accruals"]) == (100.0, 500.0, 30.0, 0.02)
        assert first["capex"] is None and second["capex"] == pytest.approx(70 / 2000) and second["revenue_growth"] == 1.0

    def test_zero_denominators_and_gaps(self, spark):
        zero = fundamentals.annual_ratios(self.table(spark, total_assets=0.0, share_capital=-400.0, sales=0.0, shares=0.0)).collect()[-1]
        assert all(zero[c] is None for c in ("leverage", "roa", "roe", "net_margin", "eps", "bvps", "dps", "capex", "revenue_growth", "accruals"))
        gap = fundamentals.annual_ratios(self.table(spark, ends=(2020, 2022))).orderBy("fiscal_year_end").collect()[1]
        assert gap["capex"] is None and gap["revenue_growth"] is None and gap["roa"] == 0.05

    def test_known_events(self, spark):
        events = spark.createDataFrame([("A", dt.date(2023, 3, 31))], "symbol string, fiscal_year_end date")
        r = fundamentals.without_known_events(fundamentals.annual_ratios(self.table(spark)), events).orderBy("fiscal_year_end").collect()
        assert r[1]["revenue_growth"] is None and r[2]["revenue_growth"] == 0.5


class TestFactors:
    def test_deciles_match_quantile_cuts(self, spark):
        data, want = [], {}
        for n in (9, 10, 11, 25, 57, 209):
            ranks = pd.Series(range(1, n + 1))
            label = pd.qcut(ranks, 10, labels=False) + 1 if n >= 10 else pd.Series([None] * n)
            for i in range(n):
                data.append((day(n), f"s{i:03d}", float(i)))
                want[day(n), f"s{i:03d}"] = None if n < 10 else int(label[i])
        got = factors.size_decile(spark.createDataFrame(data, "date date, symbol string, size double"))
        assert {(r["date"], r["symbol"]): r["size_decile"] for r in got.collect()} == want

    def test_dummies_and_flags(self, spark):
        df = spark.createDataFrame([(day(0), "a", 1), (day(0), "b", 2), (day(0), "c", None)], "date date, symbol string, size_decile int")
        assert [tuple(r) for r in factors.decile_dummies(df, buckets=2).orderBy("symbol").select("size_decile_2").collect()] == [(0,), (1,), (None,)]
        caps = spark.createDataFrame([(day(0), s, v) for s, v in (("a", 5.0), ("b", 5.0), ("c", 9.0), ("d", None), ("e", -1.0))], "date date, symbol string, market_cap double")
        assert [r[1] for r in rows(factors.top_flag(caps, n=2), "symbol", "top100_flag")] == [1.0, 0.0, 1.0, None, None]

    def test_beta_and_idio(self, spark):
        rng = np.random.default_rng(0)
        m = rng.normal(size=60)
        e = rng.normal(size=60)
        r = 1.5 * m + 0.3 * e
        df = spark.createDataFrame([(day(k), "a", float(r[k]), float(m[k])) for k in range(60)], "date date, symbol string, ret double, market_ret double")
        out = factors.rolling_beta(df, n=40).orderBy("date").collect()
        assert out[38]["beta"] is None
        x, y = m[20:], r[20:]
        beta = np.cov(y, x)[0, 1] / x.var(ddof=1)
        assert out[59]["beta"] == pytest.approx(beta) and out[59]["idio_vol"] == pytest.approx(math.sqrt(y.var(ddof=1) - beta**2 * x.var(ddof=1)))

    def test_momentum_reversal(self, spark):
        df = spark.createDataFrame([(day(k), "a", 100.0 + 2 * k) for k in range(26)], "date date, symbol string, price double")
        assert rows(factors.reversal(df, lookback=21), "date", "reversal")[25][1] == pytest.approx(-(150 / 108 - 1))
        assert rows(factors.momentum(df, lookback=20, skip=5), "date", "momentum")[25][1] == pytest.approx(140 / 110 - 1)

    def test_liquidity_and_holidays(self, spark):
        data = [(day(k), s, v * (0.0 if k == 3 else 1.0), 10 * v) for k in range(8) for s, v in (("a", 1000.0), ("b", 2000.0))]
        df = factors.holiday_filled(spark.createDataFrame(data, "date date, symbol string, volume double, shares double"))
        assert {r["volume_filled"] for r in df.where("symbol = 'a'").collect()} == {1000.0}
        got = factors.liquidity(df, n=5).where("symbol = 'a'").orderBy("date").collect()
        assert got[3]["liquidity"] is None and got[7]["liquidity"] == pytest.approx(math.log(0.1))
        none = factors.liquidity(df.withColumn("volume_filled", F.lit(0.0)), n=5)
        assert none.where("liquidity is not null").count() == 0

    def test_composites_and_surprise(self, spark):
        df = spark.createDataFrame([(day(0), s, p, e, b, d) for s, p, e, b, d in (("a", 10.0, 1.0, 5.0, 0.0), ("b", 10.0, 2.0, 6.0, 0.1), ("c", 10.0, -1.0, None, 0.2), ("d", 10.0, 3.0, 8.0, None))], "date date, symbol string, price double, eps double, bvps double, dps double")
        got = dict(rows(factors.value_composite(df), "symbol", "value"))
        assert got["c"] is None and got["d"] > got["a"]
        q = [(f"2022-{m:02d}-28", v) for m, v in ((3, 10.0), (6, 20.0), (9, 10.0), (12, 10.0))] + [(f"2023-{m:02d}-28", v) for m, v in ((3, 12.0), (6, 25.0), (9, 13.0), (12, 11.0))]
        quarters = spark.createDataFrame([("a", dt.date.fromisoformat(d), v) for d, v in q], "symbol string, quarter_end date, net_profit double")
        got = factors.seasonal_surprise(quarters).orderBy("quarter_end").collect()
        assert [r["sue"] is None for r in got] == [True] * 6 + [False] * 2
        assert got[6]["sue"] == pytest.approx(3 / np.std([2, 5, 3], ddof=1)) and got[6]["announced"] == dt.date(2023, 11, 12)


class TestRegression:
    def make(self, spark, n_dates=6, n=60):
        rng = np.random.default_rng(1)
        x, r = [], []
        coef = np.array([0.01, -0.02, 0.005])
        for k in range(n_dates):
            for i in range(n):
                one, a, b = 1.0, rng.normal(), rng.normal()
                x.append((day(k), f"s{i:02d}", one, a, b, float(rng.uniform(1, 100))))
                r.append((day(k + 1), f"s{i:02d}", float(coef @ [one, a, b] + 0.055 / 252 + rng.normal() * 1e-5)))
        return spark.createDataFrame(x, "date date, symbol string, one double, a double, b double, market_cap double"), spark.createDataFrame(r, "date date, symbol string, ret double"), coef

    def test_recovery_and_orthogonality(self, spark):
        x, r, coef = self.make(spark)
        clean, flagged = regression.split_outliers(regression.aligned(x, r))
        fits = regression.cross_sectional_fits(regression.complete_cases(clean, ["one", "a", "b"]), ["one", "a", "b"])
        got = regression.factor_returns(fits).groupBy("factor").agg(F.avg("ret").alias("m"), F.count("*").alias("n")).collect()
        assert {g["factor"]: round(g["m"], 4) for g in got} == {"one": 0.01, "a": -0.02, "b": 0.005} and {g["n"] for g in got} == {5}
        assert flagged.count() == 0
        resid = regression.residuals(fits).join(x.withColumn("date", F.date_add("date", 1)), ["date", "symbol"])
        assert resid.groupBy("date").agg(F.sum(F.sqrt("market_cap") * F.col("a") * F.col("residual")).alias("s")).agg(F.max(F.abs("s"))).first()[0] < 1e-9
        stats = regression.fit_statistics(fits).collect()
        assert all(s["r2"] > 0.999 and s["adj_r2"] <= s["r2"] and s["n"] == 60 for s in stats)

    def test_skips_and_flags(self, spark):
        x, r, _ = self.make(spark, n_dates=3, n=30)
        flat = r.withColumn("ret", F.when(F.col("date") == day(1), 0.0).otherwise(F.when(F.col("symbol") == "s00", 0.9).otherwise(F.col("ret"))))
        clean, flagged = regression.split_outliers(regression.aligned(x, flat))
        assert {r["raw_return"] for r in flagged.collect()} == {0.9}
        rows_ = regression.complete_cases(clean, ["a"])
        assert {s["status"] for s in regression.fit_statistics(regression.cross_sectional_fits(rows_, ["one", "a", "b"])).collect()} == {"skipped_low_n"}
        got = {s["date"]: s["status"] for s in regression.fit_statistics(regression.cross_sectional_fits(rows_, ["one", "a", "b"], least=10)).collect()}
        assert got == {day(1): "degenerate", day(2): "fitted"}

    def test_rank_deficient_takes_least_norm(self):
        x = np.column_stack((np.ones(50), np.ones(50)))
        got = regression.fit_one(x, np.full(50, 3.0), np.ones(50))
        assert np.allclose(got["coef"], 1.5)

    def test_closed_form_agrees(self, spark):
        x, r, _ = self.make(spark)
        rows_ = regression.aligned(x, r)
        a = {t["date"]: t["slope"] for t in regression.univariate_fit(rows_, "a").collect()}
        b = {t["date"]: t["ret"] for t in regression.factor_returns(regression.cross_sectional_fits(rows_, ["one", "a"])).where("factor = 'a'").collect()}
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


class TestInference:
    def test_newey_west(self, spark):
        rng = np.random.default_rng(2)
        x = rng.normal(0.1, 1, 300)
        df = spark.createDataFrame([("f", day(k), float(v)) for k, v in enumerate(x)], "factor string, date date, ret double")
        got = inference.summary(df).first()
        lag = max(1, int(4 * (300 / 100) ** (2 / 9)))
        u = x - x.mean()
        var = u @ u + 2 * sum((1 - k / (lag + 1)) * (u[k:] @ u[:-k]) for k in range(1, lag + 1))
        assert got["nw_se"] == pytest.approx(math.sqrt(var) / 300) and got["nw_t"] == pytest.approx(x.mean() / (math.sqrt(var) / 300))
        assert got["pct_positive"] == pytest.approx((x > 0).mean())

    def test_slope(self, spark):
        rng = np.random.default_rng(3)
        x = rng.normal(size=60)
        y = 0.5 + 2 * x + 0.1 * rng.normal(size=60)
        df = spark.createDataFrame([("g", day(k), float(a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "g string, date date, x double, y double")
        got = inference.newey_west_slope(df, ["g"], "x", "y").first()
        assert got["slope"] == pytest.approx(np.polyfit(x, y, 1)[0]) and got["r2"] == pytest.approx(np.corrcoef(x, y)[0, 1] ** 2) and got["nw_t"] > 20
        assert inference.newey_west_slope(df.limit(20), ["g"], "x", "y").count() == 0

    def test_months(self, spark):
        daily = spark.createDataFrame([("f", dt.date(2024, 1, 2), 0.1), ("f", dt.date(2024, 1, 3), 0.1), ("f", dt.date(2024, 2, 1), None)], "factor string, date date, ret double")
        assert rows(inference.monthly_compounded(daily), "month", "ret") == [(dt.date(2024, 1, 1), pytest.approx(0.21))]
        px = spark.createDataFrame([("p", dt.date(2024, 1, 5), 90.0), ("p", dt.date(2024, 1, 31), 100.0), ("p", dt.date(2024, 3, 1), 110.0)], "name string, date date, price double")
        assert [r[1] for r in rows(inference.monthly_change(px), "month", "change")] == [None, 0.0, pytest.approx(0.1)]

    def test_normal_tail(self, spark):
        df = spark.createDataFrame([(t,) for t in (0.0, 0.5, 1.96, -3.0)], "t double")
        for t, p in df.select("t", inference.normal_p("t")).collect():
            assert p == pytest.approx(special.normal_two_sided(t), abs=2e-7)


class TestRisk:
    def test_ewma_matches_pandas(self, spark):
        rng = np.random.default_rng(4)
        x = pd.DataFrame(rng.normal(size=(120, 3)), columns=list("abc"))
        x.iloc[5, 0] = x.iloc[118, 1] = x.iloc[119, 2] = np.nan
        df = spark.createDataFrame([(day(k), f, None if np.isnan(v) else float(v)) for k, row in x.iterrows() for f, v in row.items()], "date date, factor string, ret double")
        want = x.ewm(halflife=20, min_periods=40).cov().loc[119]
        for r in risk.ewma_covariance(df, halflife=20).collect():
            assert r["cov"] == pytest.approx(want.loc[r["row"], r["col"]], rel=1e-9)
        means = x.ewm(halflife=20).mean().iloc[-1]
        assert {r["factor"]: pytest.approx(means[r["factor"]]) for r in risk.ewma_mean(df, halflife=20).collect()} == {r["factor"]: r["mean"] for r in risk.ewma_mean(df, halflife=20).collect()}
        spec = risk.ewma_specific_risk(df.select("date", F.col("factor").alias("symbol"), F.col("ret").alias("residual")), halflife=20)
        var = x.ewm(halflife=20).var().ffill().iloc[-1]
        assert {r["symbol"]: r["specific_risk"] for r in spec.collect()} == {k: pytest.approx(math.sqrt(v * 252)) for k, v in var.items()}
        assert risk.ewma_covariance(df, halflife=20, least=500).where("cov is not null").count() == 0

    def test_stock_covariance(self, spark):
        x = spark.createDataFrame([("p", "f", 1.0), ("p", "g", 0.5), ("q", "f", -1.0), ("q", "g", 2.0), ("r", "f", 1.0)], "symbol string, factor string, x double")
        c = spark.createDataFrame([("f", "f", 0.04), ("f", "g", 0.01), ("g", "f", 0.01), ("g", "g", 0.09)], "row string, col string, cov double")
        s = spark.createDataFrame([("p", 0.2), ("q", 0.3)], "symbol string, specific_risk double")
        got = {(r["row"], r["col"]): r["cov"] for r in risk.stock_covariance(x, c, s).collect()}
        m, f = np.array([[1, 0.5], [-1, 2]]), np.array([[0.04, 0.01], [0.01, 0.09]])
        want = m @ f @ m.T + np.diag([0.04, 0.09]) / 252
        assert got == {(a, b): pytest.approx(want[i, j]) for i, a in enumerate("pq") for j, b in enumerate("pq")}

    def test_shrinkage(self, spark):
        s = spark.createDataFrame([("a", 0.5), ("b", -2.0), ("c", 9.0)], "factor string, nw_t double")
        m = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "factor string, mean double")
        assert [r[1] for r in rows(risk.expected_factor_returns(s, m), "factor", "expected")] == [0.0, 0.5, 1.0]


class TestSolver:
    sigma = np.diag([1e-4, 4e-4, 9e-4])

    def big(self):
        rng = np.random.default_rng(5)
        b = rng.normal(size=(18, 4)) * 0.01
        return b @ b.T + np.diag(rng.uniform(1e-4, 9e-4, 18)), rng.normal(5e-4, 3e-4, 18)

    def test_least_variance(self):
        w, ok = solver.minimum_variance(self.sigma)
        want = 1 / np.diag(self.sigma)
        assert ok and np.allclose(w, want / want.sum(), atol=1e-6)

    def test_caps(self):
        w, ok = solver.minimum_variance(self.sigma, solver.Limits(cap=0.5))
        assert ok and w.max() <= 0.5 + 1e-6
        soft, ok = solver.minimum_variance(self.sigma, solver.Limits(cap=0.5, soft=True, penalty=0.001))
        tight, _ = solver.minimum_variance(self.sigma, solver.Limits(cap=0.5, soft=True, penalty=1.0))
        free, _ = solver.minimum_variance(self.sigma)
        assert ok and 0.5 < soft.max() < free.max() and tight.max() < soft.max()
        per, ok = solver.minimum_variance(self.sigma, solver.Limits(cap=np.array([0.3, 1.0, 1.0])))
        assert ok and per[0] <= 0.3 + 1e-6

    def test_groups_neutrality_leverage(self):
        sigma, mu = self.big()
        groups = np.zeros((18, 6))
        groups[np.arange(18), np.arange(18) % 6] = 1
        w, ok = solver.minimum_variance(sigma, solver.Limits(groups=groups, group_cap=0.2))
        assert ok and (groups.T @ w).max() <= 0.2 + 1e-6
        assert not solver.minimum_variance(sigma, solver.Limits(groups=groups, group_cap=0.1))[1]
        beta = np.linspace(-1, 1, 18)
        w, ok = solver.minimum_variance(sigma, solver.Limits(neutral=beta[:, None], leverage=2.0))
        assert ok and abs(beta @ w) < 1e-6 and abs(w.sum() - 1) < 1e-6 and np.abs(w).sum() <= 2 + 1e-6
        w, ok = solver.minimum_variance(sigma, solver.Limits(leverage=1.2))
        long_only, _ = solver.minimum_variance(sigma)
        assert ok and np.abs(w).sum() <= 1.2 + 1e-6 and w @ sigma @ w <= long_only @ sigma @ long_only + 1e-9
        member = (np.arange(18) < 9).astype(float)
        w, ok = solver.minimum_variance(sigma, solver.Limits(soft_group=member, soft_group_cap=0.1, soft_group_penalty=10.0))
        assert ok and member @ w < 0.11

    def test_frontier(self):
        sigma, mu = self.big()
        path = solver.frontier(sigma, mu, 10, solver.Limits(cap=0.25))
        vols, rets = [p["volatility"] for p in path], [p["expected_return"] for p in path]
        assert all(p["converged"] for p in path) and all(np.diff(vols) > -1e-8) and all(np.diff(rets) > -1e-9)
        best, ok = solver.maximum_return(mu, solver.Limits(cap=0.25))
        assert ok and mu @ best == pytest.approx(np.sort(mu)[-4:].mean(), rel=1e-5)


class TestPortfolios:
    def test_metrics(self, spark):
        s = spark.createDataFrame([("p", day(k), 0.0003) for k in range(252)], "portfolio string, date date, ret double")
        got = portfolio.performance(s).first()
        assert got["total_return"] == pytest.approx(1.0003**252 - 1) and got["ann_return"] == pytest.approx(got["total_return"]) and got["max_drawdown"] == 0 and got["calmar"] is None
        rng = np.random.default_rng(6)
        b = rng.normal(0, 0.01, 200)
        bench = spark.createDataFrame([(day(k), float(v)) for k, v in enumerate(b)], "date date, bench double")
        two = spark.createDataFrame([("two", day(k), float(2 * v)) for k, v in enumerate(b)] + [("one", day(k), float(v)) for k, v in enumerate(b)], "portfolio string, date date, ret double")
        got = {r["portfolio"]: r for r in portfolio.benchmark_relative(two, bench).collect()}
        assert got["two"]["beta"] == pytest.approx(2) and got["two"]["up_capture"] == pytest.approx(2) and got["one"]["beta"] == pytest.approx(1) and got["one"]["alpha"] == pytest.approx(0, abs=1e-12)

    def test_concentration_and_checks(self, spark):
        w = spark.createDataFrame([("p", "a", 0.5), ("p", "b", 0.3), ("p", "c", 0.2), ("q", "a", 1.2), ("q", "b", -0.2)], "portfolio string, symbol string, weight double")
        got = {r["portfolio"]: r for r in portfolio.concentration(w).collect()}
        assert got["p"]["hhi"] == pytest.approx(0.38) and got["p"]["effective_n"] == pytest.approx(1 / 0.38) and got["p"]["top1"] == 0.5
        assert dict(rows(validation.constraints(w), "portfolio", "verdict")) == {"p": "PASS", "q": "FAIL"}
        assert dict(rows(validation.constraints(w, leverage=1.5), "portfolio", "verdict")) == {"p": "PASS", "q": "PASS"}
        assert dict(rows(validation.concentration_verdict(w), "portfolio", "verdict")) == {"p": "FAIL", "q": "FAIL"}
        betas = spark.createDataFrame([("c", 1.0), ("b", -1.0), ("a", 0.2)], "symbol string, beta double")
        assert dict(rows(validation.beta_neutrality(w, betas), "portfolio", "verdict"))["p"] == "PASS"

    def test_joint_exposures(self, spark):
        x = spark.createDataFrame([("A", "top", 1.0, 2.0), ("B", "rest", 3.0, 4.0)], "symbol string, segment string, a double, b double")
        got = portfolio.joint_exposures(x, ["a", "b"], ["top", "rest"]).orderBy("symbol").select(*portfolio.joint_columns(["a", "b"], ["top", "rest"])).collect()
        assert [tuple(r) for r in got] == [(1.0, 2.0, 0.0, 0.0), (0.0, 0.0, 3.0, 4.0)]
        with pytest.raises(Exception, match="two segments"):
            portfolio.joint_exposures(x.withColumn("symbol", F.lit("A")), ["a", "b"], ["top", "rest"]).collect()

    def market(self, spark, months=36):
        """A made-up market: exposures that move, factor returns, residuals and returns of eight symbols."""
        rng = np.random.default_rng(7)
        when = [dt.date(2020 + (k // 12), k % 12 + 1, 1) for k in range(months)]
        names = "abcdefgh"
        x = {(d, s): (float(rng.random()), float(rng.random())) for d in when for s in names}
        f = {d: (float(rng.normal(0.01, 0.03)), float(rng.normal(0.0, 0.02))) for d in when}
        e = {(d, s): float(rng.normal(0, 0.01 + 0.004 * names.index(s))) for d in when for s in names}
        panel_ = spark.createDataFrame([(d, s, *x[d, s], "top" if x[d, s][0] > 0.5 else "rest", x[d, s][0] * f[d][0] + x[d, s][1] * f[d][1] + e[d, s]) for d in when for s in names], "date date, symbol string, f1 double, f2 double, segment string, ret double")
        factors_ = spark.createDataFrame([(d, n, f[d][k]) for d in when for k, n in enumerate(("f1", "f2"))], "date date, factor string, ret double")
        return panel_, factors_, spark.createDataFrame([(d, s, v) for (d, s), v in e.items()], "date date, symbol string, residual double"), (when, names, x, f, e)

    def walk(self, panel_, factors_, residuals_, dates, limits=lambda pdf: solver.Limits(cap=0.5)):
        cov, expected = backtest.factor_models(factors_, dates, 12)
        risk = backtest.specific_as_of(residuals_, dates, 12)
        rows = backtest.problems(backtest.latest_as_of(panel_, dates, ["f1", "f2"]), ["f1", "f2"], cov, expected, risk)
        return rows, backtest.walk_forward(rows, 4, limits)

    def test_backtest_sees_no_future(self, spark):
        panel_, factors_, residuals_, _ = self.market(spark)
        dates = backtest.rebalance_dates(panel.calendar(panel_), "2021-06-01")
        assert dates.count() == 20 and dates.where("until is null").count() == 1
        few = dates.where("as_of <= '2021-12-01'")
        _, w = self.walk(panel_, factors_, residuals_, few)
        wild = lambda df, c: df.withColumn(c, F.when(F.col("date") > "2021-12-01", F.lit(9.0) * F.col(c)).otherwise(F.col(c)))
        later = wild(wild(panel_, "f1"), "ret").withColumn("segment", F.lit("top"))
        _, other = self.walk(later, wild(factors_, "ret"), wild(residuals_, "residual"), few)
        key = lambda d: {(r["portfolio"], r["as_of"], r["symbol"]): round(r["weight"], 9) for r in d.collect()}
        assert key(w) == key(other) and len(key(w)) == 3 * few.count() * 8
        equal = backtest.turnover(w.where("portfolio = 'Equal-Weight'"))
        assert equal.count() == few.count() - 1 and equal.agg(F.max("turnover")).first()[0] == pytest.approx(0)
        held = backtest.held_returns(w.where("portfolio = 'Equal-Weight'"), dates, panel_)
        assert held.agg(F.min("date")).first()[0] == dt.date(2021, 6, 1)

    def test_backtest_problems_against_plain_numbers(self, spark):
        panel_, factors_, residuals_, (when, names, x, f, e) = self.market(spark)
        dates = spark.createDataFrame([(when[20], when[21]), (when[30], None)], "as_of date, until date")
        rows, w = self.walk(panel_, factors_, residuals_, dates, lambda pdf: solver.Limits())
        for as_of, part in rows.toPandas().groupby("as_of"):
            seen = [d for d in when if d <= as_of]
            age = np.array([0.5 ** ((len(seen) - 1 - k) / 12) for k in range(len(seen))])

            def cov(a, b, age=age):
                ma, mb = (age @ a) / age.sum(), (age @ b) / age.sum()
                return (age * (a - ma)) @ (b - mb) / age.sum() * age.sum() ** 2 / (age.sum() ** 2 - (age**2).sum())

            series = np.array([f[d] for d in seen])
            want = np.array([[cov(series[:, i], series[:, j]) for j in (0, 1)] for i in (0, 1)])
            part = part.sort_values("symbol")
            told = part[part["cov"].notna()].iloc[0]
            assert np.allclose(np.array([list(r) for r in told["cov"]]), want)
            own = [cov(*[np.array([e[d, s] for d in seen])] * 2) for s in names]
            assert np.allclose(part["own"], own)
            assert np.allclose(np.array(part["x"].tolist()), [x[as_of, s] for s in names])
            xs = np.array([x[as_of, s] for s in names])
            best = solver.minimum_variance(xs @ want @ xs.T + np.diag(own), solver.Limits())[0]
            got = w.where((F.col("portfolio") == "GMV") & (F.col("as_of") == F.lit(as_of))).orderBy("symbol").collect()
            assert np.allclose([r["weight"] for r in got], best, atol=1e-5)

    def test_joint_backtest_follows_members(self, spark):
        panel_, factors_, residuals_, (when, names, x, *_) = self.market(spark)
        dates = spark.createDataFrame([(when[20], when[21]), (when[30], None)], "as_of date, until date")
        both = {"top": factors_, "rest": factors_.withColumn("ret", F.col("ret") * 0.5)}
        seen = residuals_.join(panel_.select("date", "symbol", "segment"), ["date", "symbol"])
        rows = backtest.joint_problems(panel_, ["f1", "f2"], both, {s: seen.where(F.col("segment") == s) for s in both}, dates, 12)
        for r in rows.collect():
            top = x[r["as_of"], r["symbol"]][0] > 0.5
            assert r["segment"] == ("top" if top else "rest")
            assert r["x"] == ([*x[r["as_of"], r["symbol"]], 0.0, 0.0] if top else [0.0, 0.0, *x[r["as_of"], r["symbol"]]])
        w = backtest.walk_forward(rows, 3, lambda pdf: solver.Limits(cap=np.where(pdf["segment"] == "rest", 0.3, 0.6)))
        assert {r["s"] for r in w.groupBy("portfolio", "as_of").agg(F.round(F.sum("weight"), 6).alias("s")).collect()} == {1.0}

    def test_macro_tilts_see_no_future(self, spark):
        panel_, _, _, (when, names, *_) = self.market(spark, 60)
        rng = np.random.default_rng(3)
        prices = spark.createDataFrame([("oil", d, float(50 + rng.random())) for d in when], "name string, date date, price double")
        groups = spark.createDataFrame([("oil", "a"), ("oil", "b"), ("none", "c")], "name string, symbol string")
        dates = spark.createDataFrame([(when[40],), (when[50],)], "as_of date")
        got = {(r["as_of"], r["symbol"]): r["tilt"] for r in timing.macro_tilts(panel_, groups, prices, dates).collect()}
        assert set(got) == {(d, s) for d in (when[40], when[50]) for s in "ab"}
        one = {r["symbol"]: r["tilt"] for r in timing.macro_tilt(panel_, groups, prices, as_of=str(when[40])).collect()}
        assert one["a"] == pytest.approx(got[when[40], "a"]) and one["c"] == 0 and len(one) == 8
        cut = timing.macro_tilt(panel_.where(F.col("date") <= F.lit(when[40])), groups, prices.where(F.col("date") <= F.lit(when[40])))
        assert {r["symbol"]: r["tilt"] for r in cut.collect()}["b"] == pytest.approx(one["b"])



class TestTiming:
    def test_signals(self, spark):
        px = [100.0] * 40 + [100.0 + k for k in range(1, 41)]
        df = spark.createDataFrame([("i", day(k), v) for k, v in enumerate(px)], "name string, date date, price double")
        sma = timing.sma_cross(df).orderBy("date").collect()
        assert sma[28]["position"] is None and sma[29]["position"] == 1.0 and sma[79]["position"] == 1.0
        p = pd.Series(px)
        line = p.ewm(span=12, adjust=False).mean() - p.ewm(span=26, adjust=False).mean()
        got = timing.macd(df).orderBy("date").collect()
        assert np.allclose([r["macd"] for r in got], line) and np.allclose([r["signal"] for r in got], line.ewm(span=9, adjust=False).mean())
        mom = timing.series_momentum(df, lookback=20, skip=5).orderBy("date").collect()
        assert mom[24]["position"] is None and mom[79]["trailing"] == pytest.approx(px[74] / px[54] - 1)
        rets = df.select("name", "date", F.lit(0.01).alias("ret"))
        always = timing.timing_alpha(rets.withColumn("position", F.lit(1.0)), rets).first()
        assert always["excess_mean"] == 0 and always["pct_long"] == 1 and always["n"] == 79

    def test_macro_tilt(self, spark):
        rng = np.random.default_rng(8)
        months = [dt.date(2018 + k // 12, k % 12 + 1, 15) for k in range(36)]
        change = rng.normal(0, 0.05, 36)
        price = 100 * np.cumprod(1 + change)
        mom = [np.nan, np.nan, np.nan] + [price[k] / price[k - 3] - 1 for k in range(3, 36)]
        data = [(d, s, float(0.2 * mom[k - 1] if s.startswith("g") and k > 0 and not np.isnan(mom[k - 1]) else 0.0) + float(rng.normal(0, 1e-4))) for k, d in enumerate(months) for s in ("g1", "g2", "r1", "r2", "r3")]
        r = spark.createDataFrame(data, "date date, symbol string, ret double")
        px = spark.createDataFrame([("oil", d, float(p)) for d, p in zip(months, price)], "name string, date date, price double")
        g = spark.createDataFrame([("oil", "g1"), ("oil", "g2"), ("lone", "r1")], "name string, symbol string")
        got = dict(rows(timing.macro_tilt(r, g, px), "symbol", "tilt"))
        assert got["g1"] == pytest.approx(0.2 * mom[-1] / 21, rel=0.05) and got["r1"] == 0
        assert set(dict(rows(timing.macro_tilt(r, g, px, as_of="2019-06-30"), "symbol", "tilt")).values()) == {0.0}


class TestValidation:
    def test_normality_and_welch(self, spark):
        rng = np.random.default_rng(9)
        x = rng.normal(size=500)
        got = validation.jarque_bera(spark.createDataFrame([(float(v),) for v in x], "v double"), "v").first()
        u = x - x.mean()
        s, k = (u**3).mean() / (u**2).mean() ** 1.5, (u**4).mean() / (u**2).mean() ** 2 - 3
        assert got["jb"] == pytest.approx(500 / 6 * (s**2 + k**2 / 4)) and got["p"] == pytest.approx(special.chi2_tail(got["jb"], 2))
        df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (10, 4.0), (10, 6.0)], "size_decile int, ret double")
        w = validation.decile_spread(df).first()
        assert w["t"] == pytest.approx(3 / math.sqrt(1 / 3 + 2 / 2))

    def test_alpha_by_segment_sees_offsetting_biases(self, spark):
        rng = np.random.default_rng(10)
        data = [(day(k), f"s{i}", (0.002 if i % 2 else -0.002) + float(rng.normal(0, 0.005)), "odd" if i % 2 else "even") for k in range(200) for i in range(10)]
        df = spark.createDataFrame(data, "date date, symbol string, residual double, segment string")
        assert validation.residual_alpha(df.drop("segment")).first()["verdict"] == "PASS"
        assert {r["verdict"] for r in validation.residual_alpha(df, ["segment"]).collect()} == {"FAIL"}

    def test_unit_roots(self, spark):
        rng = np.random.default_rng(11)
        e = rng.normal(size=400)
        df = spark.createDataFrame([("noise", day(k), float(v)) for k, v in enumerate(e)] + [("walk", day(k), float(v)) for k, v in enumerate(np.cumsum(e))], "factor string, date date, ret double")
        assert {r["factor"]: r["stationary"] for r in validation.dickey_fuller(df).collect()} == {"noise": True, "walk": False}

    def test_autocorrelation_and_inflation(self, spark):
        rng = np.random.default_rng(12)
        e = rng.normal(size=300)
        ar = [0.0]
        for v in e:
            ar.append(0.8 * ar[-1] + v)
        df = spark.createDataFrame([("noise", day(k), float(v)) for k, v in enumerate(e)] + [("ar", day(k), float(v)) for k, v in enumerate(ar)], "symbol string, date date, residual double")
        q = dict(rows(validation.ljung_box(df), "symbol", "q"))
        assert special.chi2_tail(q["ar"], 5) < 1e-6 < 0.001 < special.chi2_tail(q["noise"], 5)
        a, b = rng.normal(size=200), rng.normal(size=200)
        x = spark.createDataFrame([(day(0), float(p), float(r), float(p + 0.05 * r)) for p, r in zip(a, b)], "date date, a double, b double, c double")
        vif = dict(rows(validation.variance_inflation(x, ["a", "b"]), "factor", "vif"))
        assert vif["a"] < 1.2 and dict(rows(validation.variance_inflation(x, ["a", "c"]), "factor", "vif"))["a"] > 100

    def test_tails(self):
        assert special.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6) and special.chi2_tail(11.0705, 5) == pytest.approx(0.05, abs=1e-5)
        assert special.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6) and special.t_two_sided(0.0, 5) == pytest.approx(1)

    def test_look_ahead_is_caught(self, spark):
        events = spark.createDataFrame([("a", day(10), 1.0), ("a", day(40), 2.0)], "symbol string, visible date, v double")
        good = spark.createDataFrame([(day(12), "a", 1.0), (day(41), "a", 2.0)], "date date, symbol string, v double")
        bad = spark.createDataFrame([(day(20), "a", 2.0)], "date date, symbol string, v double")
        assert validation.look_ahead(good, events, "v").count() == 0 and validation.look_ahead(bad, events, "v").count() == 1


class TestResolve:
    def test_names(self, spark):
        df = spark.createDataFrame([("Foo-Bar Ltd.",), ("A & B  LIMITED",), ("LTDX Limted",)], "n string")
        assert [r[0] for r in df.select(resolve.normalized_name("n")).collect()] == ["FOO BAR", "A & B", "LTDX"]
        assert spark.createDataFrame([("Foo (12)",)], "n string").select(resolve.without_copy_suffix("n")).first()[0] == "Foo"

    def test_mapping(self, spark):
        ref = spark.createDataFrame([("AAA", "Alpha Industries Ltd", 0), ("BBB", "Beta Works Limited", 1)], "symbol string, company_name string, ord int")
        files = spark.createDataFrame([("Alpha Industries.xlsx", 1.0, "Alpha Industries"), ("Alpha Industries (1).xlsx", 2.0, "Alpha Industries"), ("Beta Works.xlsx", 1.0, None), ("Nothing alike.xlsx", 1.0, "Qqq zzz"), ("Odd.xlsx", 1.0, "x"), ("Gone.xlsx", 1.0, "y")], "file string, mtime double, company_name string")
        over = spark.createDataFrame([("Odd", "AAA2"), ("Gone", None)], "dedup_key string, symbol string")
        priced = spark.createDataFrame([("AAA",), ("BBB",)], "symbol string")
        got = {r["file"]: r for r in resolve.universe_mapping(files, ref, over, priced).collect()}
        assert got["Alpha Industries (1).xlsx"]["included"] and not got["Alpha Industries.xlsx"]["included"] and got["Alpha Industries.xlsx"]["reason"] == "older download"
        assert got["Beta Works.xlsx"]["included"] and got["Beta Works.xlsx"]["company_name"] == "Beta Works"
        assert got["Nothing alike.xlsx"]["needs_review"] and got["Odd.xlsx"]["reason"] == "no prices" and got["Gone.xlsx"]["method"] == "manual_exclude"
        assert {r[0] for r in resolve.locked_universe(resolve.universe_mapping(files, ref, over, priced)).collect()} == {"AAA", "BBB"}
