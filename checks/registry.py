"""All registered queries and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["checks.lap_queries", "checks.more_lap_queries", "checks.report_queries", "checks.stream_queries", "checks.model_queries"]


def _modules():
    return [importlib.import_module(name) for name in MODULES]


def queries() -> dict:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _modules() for name, sql in module.SQL.items()}
