"""Named queries: a Spark builder plus, where SQL can say it, the equivalent
DuckDB SQL used as the correctness oracle.

Builders take ``(spark, sf_dir)`` and return a lazy DataFrame over the whole
driver tables. Every output column is aliased to the name the SQL uses.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: record ``fn`` under ``name`` (and its oracle SQL if given)."""
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from gridwork.plans import (  # noqa: F401
        basics, joins, aggregates, nulls, sets, text, nested, matrix, questions, records, significance,
    )
