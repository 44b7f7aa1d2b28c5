"""All queries by name, and the SQL that tells their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.queries import evidence, intents, linking, relational, scalars, snapshots, symbols, walks  # noqa: F401  all of them add to relational's
from factloom.queries.inputs import VIEWS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = scalars.QUERIES | relational.QUERIES
ORACLE_SQL: dict[str, str] = scalars.ORACLE_SQL | relational.ORACLE_SQL
__all__ = ["ORACLE_SQL", "QUERIES", "VIEWS"]
