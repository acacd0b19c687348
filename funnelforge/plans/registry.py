"""The registered queries of the lead-funnel operators."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES (functions) and SQL (by the functions' names).
MODULES = ("profile_queries", "ranking_queries", "lead_queries", "bureau_queries", "model_queries")


def _modules() -> list:
    return [importlib.import_module(f"funnelforge.plans.{m}") for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for m in _modules() for f in m.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
