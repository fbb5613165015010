"""The registered queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import feature_queries, metric_queries, report_queries, rule_queries, segment_queries

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (feature_queries, rule_queries, segment_queries, metric_queries, report_queries)
QUERIES: dict[str, Query] = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report_queries.flagship(spark, sf_dir)
