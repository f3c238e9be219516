"""Point-in-time joins: a value becomes visible a reporting lag after its period's end and stays until the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.constants import REPORTING_LAG_DAYS


def visible_from(events: DataFrame, end: str = "fiscal_year_end", lag_days: int = REPORTING_LAG_DAYS, out: str = "visible") -> DataFrame:
    return events.withColumn(out, F.date_add(F.col(end), lag_days))


def as_of_join(grid: DataFrame, events: DataFrame, values: list[str], by: str = "symbol", at: str = "date", visible: str = "visible") -> DataFrame:
    """For each row of ``grid`` each value's latest non-null report that is visible by then; nothing is filled backward.

    Grid and events are put in one sequence by symbol and the last report is carried along it: one shuffle, no
    range join. Reports of the same day come before the grid's row; of two on one day, the later period's stands.
    """
    rest = [c for c in grid.columns if c not in (by, at, *values)]
    left = grid.select(by, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.struct(*[F.col(c) for c in rest] or [F.lit(1).alias("_none")]).alias("_row"), *[F.lit(None).cast(events.schema[v].dataType).alias(v) for v in values])
    right = events.select(by, F.col(visible).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), *values)
    order = Window.partitionBy(by).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = left.unionByName(right).withColumns({v: F.last(v, ignorenulls=True).over(order) for v in values})
    return both.where("_kind = 1").select(F.col("_at").alias(at), by, *[F.col("_row")[c].alias(c) for c in rest], *values)


def validity(events: DataFrame, by: str = "symbol", visible: str = "visible") -> DataFrame:
    """Events with the day before which they stand: [visible, valid_to)."""
    return events.withColumn("valid_to", F.lead(visible).over(Window.partitionBy(by).orderBy(visible)))
