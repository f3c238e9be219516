"""Ratios of annual statements (symbol, fiscal_year_end, items)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.constants import NON_ANNUAL_GAP_DAYS

#: Shares are quoted in units, amounts in tens of millions. Fixed value.
AMOUNT_UNIT = 1e7


def safe_divide(a: str | Column, b: str | Column) -> Column:
    """Null instead of a division by zero."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return a / F.when(b != 0, b)


def annual_ratios(annual: DataFrame, gap_days: tuple[int, int] = NON_ANNUAL_GAP_DAYS) -> DataFrame:
    """leverage, roa, roe, net_margin, eps, bvps, dps, capex, revenue_growth and accruals of each statement.

    Capex and growth look back one statement of the symbol and are null where that is not about a year away.
    """
    order = Window.partitionBy("symbol").orderBy("fiscal_year_end")
    back = annual.withColumns({f"_{c}": F.lag(c).over(order) for c in ("net_block", "total_assets", "sales", "fiscal_year_end")})
    gap = F.datediff("fiscal_year_end", "_fiscal_year_end")
    yearly = ~F.coalesce((gap < gap_days[0]) | (gap > gap_days[1]), F.lit(False))
    equity = F.col("share_capital") + F.col("reserves")
    units = F.when(F.col("shares") > 0, F.col("shares") / AMOUNT_UNIT)
    out = back.withColumns(
        {
            "leverage": safe_divide("borrowings", equity),
            "roa": safe_divide("net_profit", "total_assets"),
            "roe": safe_divide("net_profit", equity),
            "net_margin": safe_divide("net_profit", "sales"),
            "eps": safe_divide("net_profit", units),
            "bvps": safe_divide(equity, units),
            "dps": safe_divide("dividend", units),
            "capex": F.when(yearly, safe_divide(F.col("net_block") - F.col("_net_block") + F.col("depreciation"), "_total_assets")),
            "revenue_growth": F.when(yearly, safe_divide("sales", "_sales") - 1),
            "accruals": safe_divide(F.col("net_profit") - F.col("cfo"), "total_assets"),
        }
    )
    return out.drop("_net_block", "_total_assets", "_sales", "_fiscal_year_end")


def without_known_events(ratios: DataFrame, events: DataFrame) -> DataFrame:
    """Growth and capex are nulled in the (symbol, fiscal_year_end) of ``events``, a short list."""
    marked = ratios.join(F.broadcast(events.select("symbol", "fiscal_year_end", F.lit(True).alias("_event")).distinct()), ["symbol", "fiscal_year_end"], "left")
    return marked.withColumns({c: F.when(F.col("_event").isNull(), F.col(c)) for c in ("capex", "revenue_growth")}).drop("_event")


def off_balance(annual: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """Statements whose two totals differ by more than the tolerance."""
    limit = tolerance * F.greatest(F.abs("total_assets"), F.lit(1.0))
    return annual.where(F.abs(F.col("total_assets") - F.col("total_liabilities_equity")) > limit)
