"""Queries of the engine's own operators and their DuckDB SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):  # noqa: ANN201
    """Register f(Tables) -> DataFrame under a name, with the SQL that must give the same rows."""
    from .sources.bindings import Tables, with_views

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        QUERIES[name].__doc__ = f.__doc__
        if sql:
            SQL[name] = with_views(sql)
        return f

    return add


def _load() -> None:
    from .plans import catalog  # noqa: F401  registers all queries


_load()
