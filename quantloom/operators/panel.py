"""Panels: one row for each (date, symbol). Time-series steps are windows over a symbol, cross-sections over a date.

Rolling windows count rows of the date grid, so they need the full grid (:func:`full_grid`); a window is null unless
all its rows are there and not null.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A calendar is a few thousand dates; beyond this many rows it is not broadcast.
CALENDAR_ROWS = 1_000_000


def missing_as_null(df: DataFrame, *columns: str) -> DataFrame:
    """NaN to null: Spark's aggregates skip nulls only."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def melt(wide: DataFrame, key: str = "date", name: str = "symbol", value: str = "value") -> DataFrame:
    """Wide to long: a row for each other column."""
    return wide.unpivot(key, [c for c in wide.columns if c != key], name, value)


def pivot(long: DataFrame, value: str, names: Iterable[str], key: str = "date", name: str = "symbol") -> DataFrame:
    """Long to wide for a known list of names (one aggregate each, no extra pass to find them)."""
    return long.groupBy(key).pivot(name, list(names)).agg(F.first(value, ignorenulls=True))


def calendar(panel: DataFrame) -> DataFrame:
    return panel.select("date").distinct()


def full_grid(panel: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    """All (date, symbol) pairs of the panel's dates and symbols, with the panel's values where it has them."""
    dates = dates if dates is not None else calendar(panel)
    symbols = panel.select("symbol").distinct()
    return symbols.crossJoin(F.broadcast(dates)).join(panel, ["date", "symbol"], "left")


def by_symbol() -> Window:
    return Window.partitionBy("symbol").orderBy("date")


def last_rows(n: int) -> Window:
    return by_symbol().rowsBetween(-(n - 1), 0)


def forward_filled(column: str | Column) -> Column:
    return F.last(F.col(column) if isinstance(column, str) else column, ignorenulls=True).over(by_symbol().rowsBetween(Window.unboundedPreceding, 0))


def with_returns(panel: DataFrame, price: str = "price", fill: bool = True, out: str = "ret") -> DataFrame:
    """Change against the row before. With ``fill`` a gap repeats the last price (a change of zero), never the next one."""
    padded = panel.withColumn("_padded", forward_filled(price) if fill else F.col(price))
    return padded.withColumn(out, F.col("_padded") / F.expr("nullif(lag(_padded) OVER (PARTITION BY symbol ORDER BY date), 0D)") - 1).drop("_padded")


def rolling(aggregate: Column, over: str | Column, n: int, least: int | None = None) -> Column:
    """``aggregate`` over the last n rows, null unless ``least`` (n) of them have a value."""
    w = last_rows(n)
    value = F.col(over) if isinstance(over, str) else over
    return F.when(F.count(value).over(w) >= (least or n), aggregate.over(w))


def date_range(panel: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Dates from ``start`` to before ``end``."""
    tests = ([F.col("date") >= F.lit(start).cast("date")] if start else []) + ([F.col("date") < F.lit(end).cast("date")] if end else [])
    return panel.where(reduce(lambda a, b: a & b, tests)) if tests else panel


def as_of(panel: DataFrame, date: str) -> DataFrame:
    return panel.where(F.col("date") <= F.lit(date).cast("date"))


def periods(panel: DataFrame, named: dict[str, tuple[str, str]]) -> DataFrame:
    """Rows with the name of each period they fall in."""
    hit = [F.when((F.col("date") >= F.lit(a).cast("date")) & (F.col("date") < F.lit(b).cast("date")), F.lit(k)) for k, (a, b) in named.items()]
    return panel.withColumn("period", F.explode(F.array_compact(F.array(*hit))))


def latest(panel: DataFrame, complete: Iterable[str] = ()) -> DataFrame:
    """Rows of the last date, without those that lack one of ``complete``."""
    last = panel.agg(F.max("date").alias("date"))
    rows = panel.join(F.broadcast(last), "date", "left_semi")
    return rows.dropna(subset=list(complete)) if complete else rows


def last_dates(panel: DataFrame, n: int) -> DataFrame:
    """Rows of the last n dates."""
    keep = calendar(panel).orderBy(F.desc("date")).limit(n)
    return panel.join(F.broadcast(keep), "date", "left_semi")


def every_kth_date(panel: DataFrame, sample: int) -> DataFrame:
    """Rows of at most ``sample`` dates, evenly spread: every k-th, k the whole quotient of the number of dates."""
    numbered = calendar(panel).select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("i"))
    stride = F.greatest(F.lit(1), F.floor(F.count("*").over(Window.partitionBy()) / sample))
    keep = numbered.withColumn("stride", stride).where((F.col("i") % F.col("stride") == 0) & (F.col("i") / F.col("stride") < sample)).select("date")
    return panel.join(F.broadcast(keep), "date", "left_semi")


def reindexed(values: DataFrame, keys: DataFrame, on: list[str], fill: dict[str, float] | None = None) -> DataFrame:
    out = keys.join(values, on, "left")
    return out.fillna(fill) if fill else out


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and new rows; of rows with equal keys the new one stays."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_new")))
    return both.withColumn("_first", first).where("_first = 1").drop("_first", "_new")


def month_end_dates(dates: DataFrame, start: str | None = None) -> DataFrame:
    """The last date of each month, from the month of ``start``."""
    ends = dates.groupBy(F.trunc("date", "month").alias("month")).agg(F.max("date").alias("date"))
    return (ends.where(F.col("month") >= F.trunc(F.lit(start).cast("date"), "month")) if start else ends).select("date")


def next_date(dates: DataFrame) -> DataFrame:
    """(date, target_date): each date of the shared calendar with the one that follows it; the last has none."""
    return dates.select("date", F.lead("date").over(Window.orderBy("date")).alias("target_date")).where(F.col("target_date").isNotNull())
