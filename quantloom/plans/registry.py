"""All registered queries of the engine and the SQL that checks them."""

from __future__ import annotations

from quantloom.plans import base, entities, factors, models, panels, portfolios  # noqa: F401


def queries() -> dict[str, base.Query]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
