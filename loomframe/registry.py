"""All registered queries of the library, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under ``name``, with its SQL."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


#: Modules whose import registers queries.
MODULES = ("plans.tpch", "operators.sequence", "operators.delayed", "operators.loops", "operators.grouping", "operators.ordered", "operators.spatial", "operators.graph", "operators.analytics", "operators.text", "operators.numeric", "functions.scalar", "sources.generators", "sources.formats", "sources.binary", "plans.htap", "plans.reports", "streaming.windows")


def queries() -> dict[str, Query]:
    for m in MODULES:
        import_module(f"{__package__}.{m}")
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
