"""All queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readq.plans import graph_queries, record_queries, source_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (text_queries, graph_queries, record_queries, source_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of every record."""
    return text_queries.feature_table(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
