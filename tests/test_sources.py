"""Workbooks, statements, panels, sinks and streams."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantloom.sources import prices, sinks, statements, universe, xlsx
from quantloom.streaming import events

YEARS = [dt.date(2022, 3, 31), dt.date(2023, 3, 31)]
QUARTERS = [dt.date(2022, 12, 31), dt.date(2023, 3, 31)]


def sheet(totals=2, quarters=True, name="Acme Ltd"):
    rows = [["COMPANY NAME", name], ["META"], [], ["PROFIT & LOSS"], ["Report Date", *YEARS], ["Sales", 100, 110], ["Net profit", 10, "n/a"], ["Depreciation:", 3, 4]]
    rows += [["Quarters"], ["Report Date", *QUARTERS], ["Sales", 25, 26], ["Net profit", 2, 3]] if quarters else []
    rows += [["BALANCE SHEET"], ["Report Date", *YEARS], ["Equity Share Capital", 5, 5], ["Reserves", 20, 25]]
    rows += [["Total", 90, 95]] if totals else []
    rows += [["Net Block", 40, 44]] + ([["Total", 90.2, 99]] if totals > 1 else [])
    return rows + [["CASH FLOW"], ["Report Date", *YEARS], ["Cash from Operating Activity", 8, 9]]


def folder(tmp_path, **files):
    for name, rows in files.items():
        (tmp_path / f"{name}.xlsx").write_bytes(rows if isinstance(rows, bytes) else xlsx.write_sheet(rows, statements.SHEET))
    return f"file://{tmp_path}"


def test_statements(spark, tmp_path):
    where = folder(tmp_path, good=sheet(), single=sheet(totals=1), bare=sheet(totals=0, quarters=False), broken=b"not a workbook", headless=[["META"], ["x", 1]])
    items = statements.scan_statements(spark, where).cache()
    errors = {r["file"] for r in items.where("error is not null").collect()}
    assert errors == {"broken.xlsx", "headless.xlsx"}
    symbols = spark.createDataFrame([(f"{k}.xlsx", k.upper()) for k in ("good", "single", "bare")], "file string, symbol string")
    annual = {(r["symbol"], r["fiscal_year_end"]): r for r in statements.annual_table(items, symbols).collect()}
    good = annual["GOOD", YEARS[0]]
    assert (good["sales"], good["depreciation"], good["cfo"], good["total_assets"], good["total_liabilities_equity"]) == (100, 3, 8, 90.2, 90)
    assert annual["GOOD", YEARS[1]]["net_profit"] is None
    assert annual["SINGLE", YEARS[0]]["total_assets"] == annual["SINGLE", YEARS[0]]["total_liabilities_equity"] == 90
    assert annual["BARE", YEARS[0]]["total_assets"] is None
    quarterly = statements.quarterly_table(items, symbols)
    assert sorted((r["symbol"], r["quarter_end"], r["net_profit"]) for r in quarterly.where("symbol <> 'SINGLE'").collect()) == [("GOOD", QUARTERS[0], 2.0), ("GOOD", QUARTERS[1], 3.0)]
    assert {r["company_name"] for r in items.where("error is null").collect()} == {"Acme Ltd"}


def test_section_bounds():
    labels = [statements.label_key(x) for x in ("META:", "a", "Quarters", None, "balance sheet ", "META")]
    assert statements.section_bounds(labels) == {"META": (1, 2), "Quarters": (3, 4), "BALANCE SHEET": (5, 6)}


def test_workbook_round_trip(spark, tmp_path):
    rows = [["Symbol", "Company Name", "w"], ["A", "Alpha & <Co>", 0.25], ["B", "Beta", None], ["A", "Alpha & <Co>", 0.25]]
    (tmp_path / "ref.xlsx").write_bytes(xlsx.write_sheet(rows, "Industry Exposure Matrix"))
    where = f"file://{tmp_path}/ref.xlsx"
    assert sorted((r["symbol"], r["company_name"], r["ord"]) for r in universe.reference_companies(spark, where).collect()) == [("A", "Alpha & <Co>", 0), ("B", "Beta", 1)]
    symbols = spark.createDataFrame([("B",), ("Z",)], "symbol string")
    assert {(r["symbol"], r["w"]) for r in universe.industry_weights(spark, where, symbols, ["w"]).collect()} == {("B", None), ("Z", None)}
    (tmp_path / "flags.csv").write_text("Symbol,is_psu\nB,1\n")
    assert {(r["symbol"], r["flag"]) for r in universe.static_flags(spark, f"file://{tmp_path}/flags.csv", symbols).collect()} == {("B", 1), ("Z", 0)}
    (tmp_path / "avail.csv").write_text("Symbol,Status\nA,OK\nB,MISSING\n")
    assert [r[0] for r in universe.priced_symbols(spark, f"file://{tmp_path}/avail.csv").collect()] == ["A"]
    assert universe.overrides(spark, {"x": None, "y": "Y"}).count() == 2


def test_wide_prices(spark, tmp_path):
    wide = spark.createDataFrame([(dt.datetime(2024, 1, 1), 1.0, 10.0, 5.0), (dt.datetime(2024, 1, 2), 2.0, float("nan"), 6.0)], "Date timestamp, A double, B double, IDX double")
    path = f"file://{tmp_path}/p"
    wide.write.parquet(path)
    px, missing = prices.load_wide(spark, path, ["A", "B", "Q"])
    assert missing == ["Q"] and px.count() == 4 and px.where("symbol = 'B' and value is null").count() == 1
    r = prices.returns_view(prices.load_prices(spark, path), "IDX")
    assert {(x["symbol"], x["ret"]) for x in r.where("date = '2024-01-02'").collect()} == {("A", 1.0), ("B", 0.0)}
    assert prices.benchmark_returns_view(prices.load_prices(spark, path), "IDX").where("market_ret is not null").first()["market_ret"] == pytest.approx(0.2)
    assert prices.load_benchmark(spark, path, "IDX").count() == 2 and prices.load_volume(spark, path, ["A"]).columns == ["date", "symbol", "volume"]
    fetched = prices.load_prices(spark, path, ["A"]).where("date = '2024-01-02'").withColumn("price", F.lit(7.0))
    assert prices.refreshed(prices.load_prices(spark, path, ["A"]), fetched).where("price = 7").count() == 1


def test_sinks(spark, tmp_path):
    paths = sinks.OutputPaths(f"file://{tmp_path}/out", f"file://{tmp_path}/data").scoped("periods", "early")
    df = spark.createDataFrame([("beta", 1.0), ("Materials", 2.0), ("psu_flag", 3.0), ("own", 4.0)], "factor string, mean double")
    places = sinks.save(df, paths, "summary", "csv")
    assert len(places) == 2 and all(spark.read.csv(p, header=True).count() == 4 for p in places) and "periods/early" in places[0]
    assert [(r["factor"], r["type"]) for r in sinks.labelled_summary(df).collect()] == [("Materials", "Industry"), ("beta", "Style"), ("psu_flag", "Indicator"), ("own", "Style")]
    assert sinks.experiment_scope(0.2, False, 0.2, True, 1.2) == "rest20_noindcap_restcap20_macrotiming_longshort20"
    text = sinks.report("Checks", spark.createDataFrame([("a", "PASS"), ("b|c", "FAIL")], "name string, verdict string"), {"More": df})
    assert text.startswith("# Checks\n\n1 PASS, 1 FAIL") and "b\\|c" in text and "## More" in text


def test_streams(spark, tmp_path):
    raw = spark.createDataFrame([(k, dt.datetime(2024, 1, 1, k % 24, 0), k % 3, "ab"[k % 2], float(k)) for k in range(48)], "event_id long, ts timestamp, user_id long, event_type string, value double")
    for k in range(3):
        raw.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/ev")
    stream = events.read_events(spark, f"file://{tmp_path}/ev")
    got = events.run_to_end(events.windowed(stream, "6 hours"), "windows")
    want = events.windowed(raw, "6 hours")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert events.windowed(raw, "6 hours", "3 hours").count() > want.count()
    assert events.sessions(raw, "90 minutes").agg(F.sum("n")).first()[0] == 48
    final = events.run_to_end(events.online_average(stream, 0.5), "averages", "update").groupBy("event_type").agg(F.max("n").alias("n")).collect()
    assert {r["event_type"]: r["n"] for r in final} == {"a": 24, "b": 24}
