"""Registry of the engine's own queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from treeloom.plans import relational, structural


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return structural.near_duplicate_documents(spark, d)


def queries() -> dict[str, Callable]:
    return {**relational.QUERIES, **structural.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**relational.SQL, **structural.SQL}
