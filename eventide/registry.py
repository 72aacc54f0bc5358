"""All registered queries of the event-time library and their DuckDB twins."""

from __future__ import annotations

from .plans import catalog


def queries() -> dict:
    return dict(catalog.QUERIES)


def oracle_sql() -> dict:
    return dict(catalog.ORACLES)
