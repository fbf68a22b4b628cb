"""Registry of named queries: each key pairs a Spark plan with oracle SQL.

A query is a function ``(spark, sf_dir) -> DataFrame`` over the driver
tables (through ``chainlake.fixtures``).  Its oracle is DuckDB SQL over the
same tables, or ``None`` for operators that are not expressible in SQL
(streaming state, side-effecting sinks), which get a rows-only check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chainlake.fixtures import with_views

QueryFn = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, QueryFn] = {}
_ORACLE_SRC: dict[str, tuple[str, tuple[str, ...]]] = {}


def query(key: str, sql: str | None = None, views: tuple[str, ...] = ()):
    """Register ``fn`` under ``key`` with optional oracle SQL needing ``views``."""

    def deco(fn: QueryFn) -> QueryFn:
        if key in REGISTRY:
            raise ValueError(f"duplicate query key {key}")
        REGISTRY[key] = fn
        if sql is not None:
            _ORACLE_SRC[key] = (sql, views)
        return fn

    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from chainlake.plans import (  # noqa: F401
        q_billing,
        q_delivery,
        q_quality,
        q_registry,
        q_sources,
        q_store,
        q_streaming,
    )


def oracle() -> dict[str, str]:
    """Oracle SQL of every registered query, with its views inlined as CTEs
    (resolved after all modules registered their views)."""
    load_all()
    return {k: with_views(sql, *views) for k, (sql, views) in _ORACLE_SRC.items()}
