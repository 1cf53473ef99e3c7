"""All registered queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quiver.plans import analytics, hygiene, lookups, pipeline, search, sync, tools

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (lookups, hygiene, analytics, search, sync, pipeline, tools)


def queries() -> dict[str, Query]:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
