"""Query registry: every query of the library with the SQL it is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .catalog import Query
from .operators import administration, claims, constraints, crawling, exchange, extraction, governance, matching, operations, quality, records, registries, review, web, workbench
from .plans import reports, runs
from .streaming import streams

MODULES = (extraction, records, review, quality, web, operations, governance, constraints, workbench, administration, matching, crawling, claims, exchange, registries, runs, reports, streams)


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """The flagship: order numbers with evidence, from generated order text to one ranked winner for each order."""
    return extraction.order_number(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
