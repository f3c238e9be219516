"""Workbooks without extra libraries: a sheet is zipped XML. Files are read by Spark, each parsed where it lands."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import date, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_EPOCH = date(1899, 12, 30)


def _column(ref: str) -> int:
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(c) - 64
    return n - 1


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_MAIN}t"))


def _date_styles(book: zipfile.ZipFile) -> set[int]:
    """Styles whose number format shows a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    custom = {int(f.get("numFmtId")): f.get("formatCode", "") for f in root.iter(f"{_MAIN}numFmt")}
    out = set()
    cells = root.find(f"{_MAIN}cellXfs")
    for i, xf in enumerate(cells if cells is not None else []):
        k = int(xf.get("numFmtId", 0))
        code = re.sub(r'"[^"]*"|\[[^\]]*\]', "", custom.get(k, ""))
        if 14 <= k <= 22 or re.search("[dy]", code, re.IGNORECASE):
            out.add(i)
    return out


def sheet_rows(raw: bytes, sheet: str) -> list[list[str | None]]:
    """Rows of cells as text; dates as year-month-day. KeyError if there is no such sheet."""
    with zipfile.ZipFile(io.BytesIO(raw)) as book:
        names = set(book.namelist())
        shared = [_text(si) for si in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_MAIN}si")] if "xl/sharedStrings.xml" in names else []
        dates = _date_styles(book)
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        found = {s.get("name"): links[s.get(f"{_REL}id")] for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_MAIN}sheet")}
        target = found[sheet].lstrip("/")
        root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
    out: list[list[str | None]] = []
    for k, row in enumerate(root.iter(f"{_MAIN}row")):
        at = int(row.get("r", k + 1)) - 1
        while len(out) < at:
            out.append([])
        cells: list[str | None] = []
        for i, c in enumerate(row.iter(f"{_MAIN}c")):
            j = _column(c.get("r")) if c.get("r") else i
            cells += [None] * (j + 1 - len(cells))
            value = c.find(f"{_MAIN}v")
            kind = c.get("t")
            if kind == "inlineStr":
                cells[j] = _text(c)
            elif value is not None and value.text is not None:
                if kind == "s":
                    cells[j] = shared[int(value.text)]
                elif kind in (None, "n") and int(c.get("s", -1)) in dates:
                    cells[j] = str(_EPOCH + timedelta(days=int(float(value.text))))
                else:
                    cells[j] = value.text
        out.append(cells)
    return out


def write_sheet(rows: list[list[object]], sheet: str) -> bytes:
    """A small workbook of one sheet (numbers, texts and dates), for tests and exports."""
    def cell(i: int, j: int, v: object) -> str:
        ref, n = "", j + 1
        while n:
            n, r = divmod(n - 1, 26)
            ref = chr(65 + r) + ref
        at = f'r="{ref}{i + 1}"'
        if v is None:
            return ""
        if isinstance(v, date):
            return f'<c {at} s="1"><v>{(v - _EPOCH).days}</v></c>'
        if isinstance(v, int | float):
            return f"<c {at}><v>{v}</v></c>"
        text = str(v).replace("&", "&amp;").replace("<", "&lt;")
        return f'<c {at} t="inlineStr"><is><t>{text}</t></is></c>'

    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    body = "".join(f'<row r="{i + 1}">' + "".join(cell(i, j, v) for j, v in enumerate(r)) + "</row>" for i, r in enumerate(rows))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        book.writestr("xl/styles.xml", f'<styleSheet {space}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{body}</sheetData></worksheet>")
    return out.getvalue()


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """(file, row, cells): the rows of a sheet with a header, cells by the header's names."""

    def parse(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out = []
            for file, raw in zip(pdf["path"], pdf["content"], strict=True):
                head, *rows = sheet_rows(bytes(raw), sheet)
                out += [(file, i, {h: (r[j] if j < len(r) else None) for j, h in enumerate(head) if h is not None}) for i, r in enumerate(rows)]
            yield pd.DataFrame(out, columns=["file", "row", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, "file string, row long, cells map<string,string>").withColumn("file", F.element_at(F.split("file", "/"), -1))
