"""All commands, end to end, on a small made-up market."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from quantloom.plans import commands as cmd
from quantloom.sources import statements, xlsx

N, DAYS = 24, 130
INDUSTRIES = ["Metals", "Energy"]


@pytest.fixture(scope="module")
def market(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("market")
    rng = np.random.default_rng(0)
    dates = pd.bdate_range("2022-01-03", periods=DAYS)
    symbols = [f"S{i:02d}" for i in range(N)]
    m = rng.normal(0.0005, 0.01, DAYS)
    beta = rng.uniform(0.5, 1.5, N)
    r = m[:, None] * beta + rng.normal(0, 0.012, (DAYS, N))
    px = pd.DataFrame(100 * np.cumprod(1 + r, axis=0), columns=symbols).assign(INDEX=1000 * np.cumprod(1 + m), Date=dates)
    vol = pd.DataFrame(rng.uniform(1e4, 1e5, (DAYS, N)), columns=symbols).assign(Date=dates)
    (root / "in").mkdir()
    px.to_parquet(root / "in/prices.parquet")
    vol.to_parquet(root / "in/volume.parquet")
    (root / "in/fundamentals").mkdir()
    ends = [dt.date(y, 3, 31) for y in (2019, 2020, 2021)]
    for i, s in enumerate(symbols):
        v = rng.uniform(50, 150, 12)
        grow = [1, 1.1 + 0.01 * i, 1.3]
        rows = [["COMPANY NAME", f"Company {chr(65 + i)}{chr(66 + i)}{chr(67 + i)} Ltd"], ["PROFIT & LOSS"], ["Report Date", *ends], ["Sales", *[v[0] * g for g in grow]], ["Net profit", *[v[1] / 10 * g for g in grow]], ["Depreciation", 1, 1, 1], ["Dividend Amount", *[v[2] / 50] * 3]]
        rows += [["BALANCE SHEET"], ["Report Date", *ends], ["Equity Share Capital", *[v[3]] * 3], ["Reserves", *[v[4]] * 3], ["Borrowings", *[v[5]] * 3], ["Total", *[3 * v[6]] * 3], ["Net Block", *[v[7] * g for g in grow]], ["Total", *[3 * v[6]] * 3], ["No. of Equity Shares", *[1e6 * v[8]] * 3]]
        rows += [["CASH FLOW"], ["Report Date", *ends], ["Cash from Operating Activity", *[v[9] / 10] * 3]]
        (root / f"in/fundamentals/{s} file.xlsx").write_bytes(xlsx.write_sheet(rows, statements.SHEET))
    w = rng.uniform(0, 1, N)
    reference = [["Symbol", "Company Name", *INDUSTRIES], *[[s, f"Company {chr(65 + i)}{chr(66 + i)}{chr(67 + i)} Limited", w[i], 1 - w[i]] for i, s in enumerate(symbols)]]
    (root / "in/reference.xlsx").write_bytes(xlsx.write_sheet(reference, "Industry Exposure Matrix"))
    (root / "in/availability.csv").write_text("Symbol,Status\n" + "".join(f"{s},OK\n" for s in symbols))
    (root / "in/flags.csv").write_text("Symbol,is_psu\n" + "".join(f"{s},{i % 3 // 2}\n" for i, s in enumerate(symbols)))
    pd.DataFrame({"date": [d.date() for d in dates[-2:]], "symbol": ["S00", "S00"], "price": [1.0, 2.0]}).to_parquet(root / "in/fetched.parquet")
    months = pd.date_range("2019-01-31", periods=44, freq="ME")
    pd.DataFrame({"name": "oil", "date": [d.date() for d in months], "price": 50 + rng.normal(0, 3, 44)}).to_parquet(root / "in/macro.parquet")
    (root / "in/macro_groups.csv").write_text("name,symbol\noil,S01\noil,S02\n")
    s = cmd.Settings(data=f"file://{root}/in", output=f"file://{root}/out", industries=INDUSTRIES, lookback=15, skip=3, least=15, top_n=12, halflife=20, start="2022-05-01", points=4, backtest_points=3, industry_cap=0.8, periods={"spring": ("2022-01-01", "2022-05-01"), "never": ("1990-01-01", "1991-01-01")}, stock_cap=0.2)
    c = cmd.Commands(spark, s)
    c.run_all()
    return c


def test_model(market):
    assert market.universe().count() == N
    x = market.load("exposures")
    assert x.count() == N * DAYS and set(market.s.design) <= set(x.columns)
    verdicts = {r["name"]: r["verdict"] for r in market.load("validation").collect()}
    assert verdicts["industry weights"] == "PASS" and verdicts["no look-ahead"] == "PASS" and len(verdicts) == 13
    assert market.load("factor_covariance").count() == len(market.s.design) ** 2
    assert market.load("specific_risk").count() == N
    assert "Model checks" in "\n".join(r[0] for r in market.spark.read.text(market.paths.at("validation_report")).collect())


def test_portfolios(market):
    w = market.optimize_portfolio()
    sums = {r["portfolio"]: r["s"] for r in w.groupBy("portfolio").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "s").collect()}
    assert set(sums) == {"GMV", "Max-Sharpe", "Equal-Weight"} and all(abs(v - 1) < 1e-6 for v in sums.values())
    got = {(r["name"], r["detail"]): r["verdict"] for r in market.validate_portfolio().collect()}
    assert all(v == "PASS" for (n, _), v in got.items() if n in ("constraints", "positive covariance", "variance", "monotone frontier"))
    metrics = market.backtest_portfolio().collect()
    assert {r["portfolio"] for r in metrics} == {"GMV", "Max-Sharpe", "Equal-Weight"} and all(r["n"] > 20 for r in metrics)


def test_periods_segments_and_refresh(market):
    assert set(market.run_periods()) == {"spring"}
    market.s.least = 8
    assert set(market.run_segments()) == {"top100", "rest"}
    w = market.optimize_portfolio_segments()
    assert w.where("portfolio = 'GMV'").count() == N
    assert market.validate_portfolio_segments().where("name = 'constraints' AND verdict = 'PASS'").count() == 3
    assert market.backtest_portfolio_segments().count() == 3
    got = market.refresh_prices()
    assert got.where("symbol = 'S00' AND price = 2.0").count() == 1 and got.count() == (N + 1) * DAYS


def test_options(market):
    a = cmd.parser().parse_args(["backtest-portfolio-segments", "--data", "d", "--output", "o", "--long-short", "--macro-timing", "--no-industry-cap", "--rest-max-stock-weight", "0.05"])
    s = cmd.settings_of(a)
    assert (s.leverage, s.macro_timing, s.industry_cap, s.rest_cap) == (1.2, True, None, 0.05)
    market.s.macro_timing, market.s.leverage = True, 1.2
    assert market.scope("portfolio") == ("portfolio", "macrotiming_longshort20")
    w = market.optimize_portfolio()
    assert w.where("portfolio = 'GMV'").count() == N
    market.s.macro_timing, market.s.leverage = False, None
