"""Registered queries against their SQL on DuckDB, and the contract of the registry."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from quantloom.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]
CHOSEN = ["winsor_zscore", "panel_returns_pad", "period_slices", "upsert_refresh", "rolling_beta", "holiday_ffill", "pit_asof", "value_composite", "size_decile", "exposure_panel", "wls_groups_fitted", "newey_west_summary", "macro_regression", "joint_cov", "stock_covariance", "risk_decomposition", "gmv_diagonal", "backtest_turnover", "macd", "macro_tilt", "ljung_box", "look_ahead_check", "name_normalize", "event_sessions", "wls_full", "residuals", "breusch_pagan", "beta_neutral", "max_return_capped", "walk_forward_specific", "walk_forward_expected", "walk_forward_diagonal", "joint_specific_risk", "universe_mapping", "pivot_wide"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", CHOSEN)
def test_same_values(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    got = ordered(tuple(r) for r in df.select(*columns).collect())
    assert got and got == ordered(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_contract(spark):
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and len(registry.queries()) > 120
    assert __spark_entry__.entry(spark).count() > 0
