"""Named queries and, where SQL can say the same, the SQL text that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans.oracle_base import with_ctes

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, tuple[tuple[str, ...], str]] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, ctes: tuple[str, ...] = (), sql: str | None = None):
    """Register a query under a name with the inventory ids it covers and its checking SQL."""

    def keep(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            _SQL[name] = (ctes, sql)
        return fn

    return keep


def oracle_texts() -> dict[str, str]:
    """Checking SQL of every query that has one, with its shared table expressions."""
    return {name: with_ctes(ctes, sql) for name, (ctes, sql) in _SQL.items()}
