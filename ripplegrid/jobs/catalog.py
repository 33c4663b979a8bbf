"""Every query of the library by name, and the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ripplegrid.jobs import network_queries, report_queries, score_queries, source_queries, study_queries, table_queries

_ALL = {**score_queries.QUERIES, **table_queries.QUERIES, **report_queries.QUERIES, **network_queries.QUERIES, **source_queries.QUERIES, **study_queries.QUERIES}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    """SQL of all queries but those that it cannot express."""
    return {f.__name__: sql for f, sql in _ALL.items() if sql is not None}
