"""The queries of the library outside the llm package, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quirework.plans import duplicates, relational, scalars, statements  # noqa: F401 - statements register with the relational ones

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for _plan in (duplicates, relational, scalars):
    QUERIES |= _plan.QUERIES
    ORACLE_SQL |= _plan.ORACLE_SQL
