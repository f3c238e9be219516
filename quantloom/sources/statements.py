"""Company statements out of workbooks: a sheet of labelled rows in sections, dates across.

The sheet is parsed where the file lands, into (file, company_name, section, label, period_end, value); a file that
cannot be parsed gives one row with its error instead of stopping the scan.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.sources.xlsx import sheet_rows

SHEET = "Data Sheet"

# Section headers and row labels of a statement sheet.
SECTIONS = ["META", "PROFIT & LOSS", "Quarters", "BALANCE SHEET", "CASH FLOW", "PRICE", "DERIVED"]
QUARTERLY = ["Sales", "Expenses", "Other Income", "Depreciation", "Interest", "Profit before tax", "Tax", "Net profit", "Operating Profit"]
LIABILITIES, ASSETS = "Total Liabilities & Equity", "Total Assets"

SCHEMA = "file string, company_name string, part string, label string, period_end date, value double, error string"

#: Labels of the annual items that the ratios use, and their columns.
ANNUAL_COLUMNS = {
    "Sales": "sales",
    "Net profit": "net_profit",
    ASSETS: "total_assets",
    LIABILITIES: "total_liabilities_equity",
    "Equity Share Capital": "share_capital",
    "Reserves": "reserves",
    "Borrowings": "borrowings",
    "Net Block": "net_block",
    "Depreciation": "depreciation",
    "Cash from Operating Activity": "cfo",
    "No. of Equity Shares": "shares",
    "Dividend Amount": "dividend",
}


def label_key(cell: str | None) -> str:
    return "" if cell is None else cell.strip().rstrip(":").upper()


def as_number(cell: str | None) -> float | None:
    try:
        return float(cell) if cell is not None else None
    except ValueError:
        return None


def as_date(cell: str | None) -> date | None:
    stamp = pd.to_datetime(cell, errors="coerce")
    return None if pd.isna(stamp) else stamp.date()


def section_bounds(labels: list[str]) -> dict[str, tuple[int, int]]:
    """Rows of each section: from after its first header to the next header."""
    first = {s: labels.index(s.upper()) for s in SECTIONS if s.upper() in labels}
    starts = sorted(first.values()) + [len(labels)]
    return {s: (r + 1, starts[starts.index(r) + 1]) for s, r in first.items()}


def parse_statement(rows: list[list[str | None]]) -> list[tuple[str | None, str, str, date, float | None]]:
    """(company, annual or quarterly, label, period end, value) of a sheet; ValueError if a needed part is missing."""
    labels = [label_key(r[0]) if r else "" for r in rows]
    bounds = section_bounds(labels)
    company = next((r[1] for r, k in zip(rows, labels, strict=True) if k == "COMPANY NAME" and len(r) > 1), None)

    def block(section: str) -> tuple[list[date | None], range] | None:
        if section not in bounds:
            return None
        at = [i for i in range(*bounds[section]) if labels[i] == "REPORT DATE"]
        if not at:
            return None
        cells = rows[at[0]][1:]
        n = sum(c is not None and c != "" for c in cells)
        return [as_date(c) for c in cells[:n]], range(*bounds[section])

    annual = block("PROFIT & LOSS")
    if annual is None or "BALANCE SHEET" not in bounds:
        raise ValueError("no profit and loss section with dates, or no balance sheet")
    dates = annual[0]
    out = []

    def emit(part: str, label: str, row: int | None, ends: list[date | None]) -> None:
        for k, end in enumerate(ends):
            if end is not None:
                cells = rows[row][1:] if row is not None else []
                out.append((company, part, label, end, as_number(cells[k]) if k < len(cells) else None))

    for section in ("PROFIT & LOSS", "BALANCE SHEET", "CASH FLOW"):
        seen: set[str] = set()
        for i in range(*bounds.get(section, (0, 0))):
            if labels[i] and labels[i] not in ("REPORT DATE", "TOTAL") and labels[i] not in seen:
                seen.add(labels[i])
                emit("annual", rows[i][0].strip().rstrip(":"), i, dates)
    # the balance sheet has two rows "Total": liabilities first, then assets; a single one stands for both
    totals = [i for i in range(*bounds["BALANCE SHEET"]) if labels[i] == "TOTAL"]
    emit("annual", LIABILITIES, totals[0] if totals else None, dates)
    emit("annual", ASSETS, totals[min(1, len(totals) - 1)] if totals else None, dates)
    quarters = block("Quarters")
    if quarters:
        at = {labels[i]: i for i in reversed(quarters[1])}
        for label in QUARTERLY:
            emit("quarterly", label, at.get(label.upper()), quarters[0])
    return out


def scan_statements(spark: SparkSession, folder: str) -> DataFrame:
    """All workbooks of a folder in long form; ``error`` says why a file gave nothing."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    out += [(name, *r, None) for r in parse_statement(sheet_rows(bytes(raw), SHEET))]
                except Exception as e:  # noqa: BLE001  whatever a broken file raises becomes its error
                    out.append((name, None, None, None, None, None, repr(e)[:500]))
            yield pd.DataFrame(out, columns=["file", "company_name", "part", "label", "period_end", "value", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(folder).select("path", "content")
    return files.mapInPandas(parse, SCHEMA)


def annual_table(items: DataFrame, symbols: DataFrame) -> DataFrame:
    """(symbol, fiscal_year_end, columns...) of the files (file, symbol) that stand for a symbol."""
    rows = items.where("part = 'annual'").join(F.broadcast(symbols.select("file", "symbol")), "file")
    picks = [F.max(F.when(F.col("label") == k, F.col("value"))).alias(v) for k, v in ANNUAL_COLUMNS.items()]
    return rows.groupBy("symbol", F.col("period_end").alias("fiscal_year_end")).agg(*picks)


def quarterly_table(items: DataFrame, symbols: DataFrame) -> DataFrame:
    rows = items.where("part = 'quarterly'").join(F.broadcast(symbols.select("file", "symbol")), "file")
    picks = [F.max(F.when(F.col("label") == k, F.col("value"))).alias(k.lower().replace(" ", "_")) for k in QUARTERLY]
    return rows.groupBy("symbol", F.col("period_end").alias("quarter_end")).agg(*picks)
