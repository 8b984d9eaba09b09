"""Integrity rules as queries that return the rows that break them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..sources.tables import load

C = Catalog()


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(rows: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(column).isNotNull()).join(parents.select(F.col(key).alias(column)), column, "left_anti")


def outside(rows: DataFrame, column: str, values: tuple) -> DataFrame:
    """Rows with a value that the closed list lacks; null is no value."""
    return rows.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows of an append-only table that vanished or changed between two snapshots."""
    others = [c for c in before.columns if c != key]
    mark = lambda df, name: df.select(key, F.xxhash64(*others).alias(name))
    both = mark(before, "was").join(mark(after, "now"), key, "left")
    return both.where("now is null or now <> was").select(key, F.when(F.col("now").isNull(), "vanished").otherwise("changed").alias("fault"))


@C.query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def unique_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(load(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@C.query("SELECT source, sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY 1, 2 HAVING count(*) > 1")
def unique_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(load(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("sha256")), "source", "sha256")


@C.query("SELECT doc_id FROM documents WHERE text IS NULL OR length(text) < 20 OR (n_chars % 103) / 100.0 > 1")
def evidence_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence must be there, and confidence lie from 0 to 1."""
    return load(spark, sf_dir, "documents").where(F.col("text").isNull() | (F.length("text") < 20) | ~((F.col("n_chars") % 103) / 100.0).between(0, 1)).select("doc_id")


@C.query("SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view', 'error')")
def enum_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outside(load(spark, sf_dir, "events"), "event_type", ("click", "view", "error")).select("event_id", "event_type")


@C.query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def foreign_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(load(spark, sf_dir, "orders"), "o_custkey", load(spark, sf_dir, "customer").where("c_acctbal > 0"), "c_custkey").select("o_custkey", "o_orderkey")


@C.query("SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'vanished' ELSE 'changed' END AS fault FROM events WHERE event_id % 50 = 0 OR event_id % 31 = 0")
def append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = load(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    after = before.where("event_id % 50 <> 0").withColumn("event_type", F.when(F.col("event_id") % 31 == 0, F.concat("event_type", F.lit("!"))).otherwise(F.col("event_type")))
    return changed(before, after, "event_id")


@C.query("SELECT event_id FROM events WHERE (event_id % 3 = 0) = (event_id % 5 = 0)")
def exactly_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly one of two references must be set."""
    k = F.col("event_id")
    rows = load(spark, sf_dir, "events").select(k, F.when(k % 3 == 0, k).alias("citizen"), F.when(k % 5 == 0, k).alias("staff"))
    return rows.where(F.col("citizen").isNull() == F.col("staff").isNull()).select("event_id")


@C.query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def golden_archived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of documents that are not archived."""
    return orphans(load(spark, sf_dir, "labels"), "doc_id", load(spark, sf_dir, "documents").where("lang = 'en'"), "doc_id").select("doc_id")


QUERIES, ORACLE_SQL = C.queries, C.oracle_sql
