"""All queries of the library and their SQL."""

from __future__ import annotations

import importlib

from corvane.catalog.base import QUERIES, SQL

for _name in ("sources", "rows", "text", "pairs", "aggregates", "sequences", "plans", "streams"):
    importlib.import_module(f"corvane.catalog.{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
