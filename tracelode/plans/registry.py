"""Named queries over the given tables, each with an SQL twin where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .views import Tables

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, with_: str = ""):
    """Register a function of :class:`Tables`; ``with_`` holds the view definitions its SQL reads."""
    def register(build: Callable[[Tables], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            _SQL[name] = (f"WITH {with_} {sql}" if with_ else sql).strip()
        return build
    return register


def _load() -> None:
    from . import (  # noqa: F401
        alert_queries, benchmark_queries, file_queries, filter_queries, function_queries, grouping_queries, ingest_queries,
        lifecycle_queries, metric_queries, rollup_queries, stream_queries, trace_queries,
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
