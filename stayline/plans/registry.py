"""Registry of named queries: slug -> (Spark builder, oracle SQL or None).

Each builder takes ``(spark, sf_dir)`` and returns a DataFrame over the
driver tables (or data Spark derives from them).  Oracle SQL is written
against the same tables for DuckDB.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def query(slug: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if slug in QUERIES:
            raise ValueError(f"duplicate query slug {slug}")
        QUERIES[slug] = fn
        if sql is not None:
            ORACLE[slug] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from stayline.plans import (queries_core, queries_business, queries_model,  # noqa: F401
                                queries_explain, queries_io)
