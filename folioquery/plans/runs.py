"""Whole runs as one plan each: no loop over documents, one report row for each stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions import text as T
from ..operators import extraction, quality, records
from ..operators.extraction import FACTS
from ..operators.quality import _BUCKET, _CAUSE, _COUNTS, _GRID, _OBSERVED
from ..sources.tables import load, order_facts, order_pages

C = Catalog()


def stage_report(**stages: tuple[DataFrame, str]) -> DataFrame:
    """(stage, n_done, n_failed) for rows of each stage and the condition under which one failed; a failed item stops nothing."""
    one = lambda name, rows, failed: rows.agg(F.count_if(~F.expr(failed)).alias("n_done"), F.count_if(F.expr(failed)).alias("n_failed")).select(F.lit(name).alias("stage"), "n_done", "n_failed")
    return reduce(DataFrame.unionByName, [one(name, rows, failed) for name, (rows, failed) in stages.items()])


def extract(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fields, losers) of pages(doc_id, page, text), from one ranking."""
    ranked = extraction.ranked(extraction.candidates(pages))
    return ranked.where("place = 1"), extraction.without_winner(ranked)


@C.query(
    """SELECT 'discover' AS stage, count(*) FILTER (starts_with(url, 'http')) AS n_done, count(*) FILTER (NOT starts_with(url, 'http')) AS n_failed FROM pages
UNION ALL SELECT 'store', count(*) FILTER (length(text) >= 20), count(*) FILTER (length(text) < 20) FROM documents
UNION ALL SELECT 'parse', count(*) FILTER (n_chars >= 80), count(*) FILTER (n_chars < 80) FROM documents"""
)
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return stage_report(discover=(load(spark, sf_dir, "pages").select("url"), "not startswith(url, 'http')"), store=(docs.select("text"), "length(text) < 20"), parse=(docs.select("n_chars"), "n_chars < 80"))


@C.query(
    f"""WITH {_GRID}, {_CAUSE}, {_OBSERVED}, a AS (SELECT 'accuracy' AS kind, field AS name, {_COUNTS} FROM outcomes GROUP BY field), f AS (SELECT cause, count(*) AS n FROM causes GROUP BY cause), b AS (SELECT bucket, {_BUCKET} FROM observed GROUP BY bucket)
SELECT kind, name, tp AS n FROM a UNION ALL SELECT 'failure', cause, n FROM f UNION ALL SELECT 'calibration', CAST(bucket AS VARCHAR), n FROM b"""
)
def full_certification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics, failure causes and calibration of one run, all from the same grid."""
    accuracy = quality.accuracy_overall(spark, sf_dir).select(F.lit("accuracy").alias("kind"), F.col("field").alias("name"), F.col("tp").alias("n"))
    causes = quality.failures(spark, sf_dir).groupBy("cause").agg(F.count(F.lit(1)).alias("n")).select(F.lit("failure").alias("kind"), F.col("cause").alias("name"), "n")
    buckets = quality.calibration_pooled(spark, sf_dir).select(F.lit("calibration").alias("kind"), F.col("bucket").cast("string").alias("name"), "n")
    return accuracy.unionByName(causes).unionByName(buckets)


@C.query(
    f"""WITH {FACTS} SELECT CASE WHEN contains(lower(department), 'health') OR contains(lower(department), 'family welfare') THEN 'health' WHEN contains(lower(department), 'education') THEN 'education' WHEN contains(lower(department), 'public works') THEN 'public_works'
WHEN contains(lower(department), 'rural development') OR contains(lower(department), 'panchayat raj') THEN 'rural_development' ELSE 'other' END AS bucket, count(*) AS n_orders, CAST(sum(CASE WHEN form = 3 THEN 1 ELSE 0 END) AS BIGINT) AS n_loose FROM facts GROUP BY 1"""
)
def orders_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order text to extracted department to acquisition bucket, with how many numbers were found by the weaker pattern."""
    best = extraction.winners(extraction.candidates(order_pages(order_facts(spark, sf_dir)), ("department", "go_number")))
    wide = best.groupBy("doc_id").agg(F.max(F.when(F.col("field") == "department", F.col("normalized"))).alias("department"), F.max(F.startswith("method", F.lit("ORDER_NUMBER_LOOSE"))).alias("loose"))
    return wide.groupBy(T.bucket(F.col("department")).alias("bucket")).agg(F.count(F.lit(1)).alias("n_orders"), F.sum(F.col("loose").cast("bigint")).alias("n_loose"))


@C.query(
    """WITH s AS (SELECT source, count(*) AS n, count(DISTINCT sha256(text)) AS n_distinct, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY source) SELECT source, n, n_distinct, bytes FROM s"""
)
def ingest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source brought, and how much of it was stored already."""
    rows = records.stored(load(spark, sf_dir, "documents"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sha256").alias("n_distinct"), F.sum("size").alias("bytes"))


QUERIES, ORACLE_SQL = C.queries, C.oracle_sql
