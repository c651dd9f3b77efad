"""All registered queries of the library."""

from __future__ import annotations

import importlib

from granary.queries.base import QUERIES, SQL

#: Modules that register queries.
MODULES = ("parsing", "tables", "analytics", "plans", "streams", "inputs", "flows")

for _name in MODULES:
    importlib.import_module(f"granary.queries.{_name}")


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
