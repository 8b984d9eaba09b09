"""Governance as folds of events: escalations, publication state, source edits, agent syncs, re-ingestion, run histories. An entry
of events is an action of its user; types stand for the actions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import Catalog
from ..functions import web as W
from ..sources.tables import load

C = Catalog()


@C.query(
    """WITH e AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), r AS (SELECT user_id, max(event_id) AS resolved FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT e.event_id, e.user_id, c.c_mktsegment AS department FROM e LEFT JOIN r USING (user_id) LEFT JOIN customer c ON c.c_custkey = e.user_id WHERE resolved IS NULL OR resolved < e.event_id"""
)
def open_escalations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escalations that nothing after them resolved."""
    events = load(spark, sf_dir, "events")
    resolved = events.where("event_type = 'purchase'").groupBy("user_id").agg(F.max("event_id").alias("resolved"))
    who = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("department"))
    rows = events.where("event_type = 'error'").join(resolved, "user_id", "left").join(who, "user_id", "left")
    return rows.where("resolved is null or resolved < event_id").select("event_id", "user_id", "department")


@C.query("SELECT user_id AS district, CASE max_by(event_type, event_id) WHEN 'purchase' THEN 'PUBLISHED' ELSE 'NOT_PUBLISHED' END AS state, count(*) AS n_changes FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY user_id")
def publication_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last of publishing and unpublishing counts."""
    rows = load(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "signup")).groupBy(F.col("user_id").alias("district"))
    last = F.max_by("event_type", "event_id")
    return rows.agg(F.when(last == "purchase", "PUBLISHED").otherwise("NOT_PUBLISHED").alias("state"), F.count(F.lit(1)).alias("n_changes"))


@C.query(
    """WITH e AS (SELECT user_id AS source_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS version FROM events WHERE event_type <> 'view')
SELECT source_id, version, event_id, CASE WHEN version = 1 THEN 'create' WHEN event_type = 'error' THEN 'retire' ELSE 'edit' END AS action FROM e"""
)
def source_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of a source is a version: the first creates it, later ones edit or retire it."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    rows = load(spark, sf_dir, "events").where("event_type <> 'view'").select(F.col("user_id").alias("source_id"), "event_id", "event_type", F.row_number().over(by).cast("bigint").alias("version"))
    action = F.when(F.col("version") == 1, "create").when(F.col("event_type") == "error", "retire").otherwise("edit")
    return rows.select("source_id", "version", "event_id", action.alias("action"))


@C.query(
    """SELECT e.event_id, e.event_type, c.c_name AS agent, n.n_name AS district FROM events e LEFT JOIN customer c ON c.c_custkey = e.user_id LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey ORDER BY e.event_id DESC LIMIT 200"""
)
def agent_sync_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entries, cut before they are joined to what names them."""
    newest = load(spark, sf_dir, "events").select("event_id", "event_type", "user_id").orderBy(F.desc("event_id")).limit(200)
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    rows = newest.join(c, newest.user_id == c.c_custkey, "left").join(n, c.c_nationkey == n.n_nationkey, "left")
    return rows.select("event_id", "event_type", F.col("c_name").alias("agent"), F.col("n_name").alias("district"))


@C.query(
    """WITH t AS (SELECT event_id // 4 AS document, event_id, event_type <> 'error' AS ok FROM events)
SELECT document, max(CASE WHEN ok THEN event_id END) AS synced_by, count(*) FILTER (NOT ok) AS n_failed, CASE WHEN max_by(ok, event_id) THEN 'synced' WHEN max(CASE WHEN ok THEN 1 ELSE 0 END) = 1 THEN 'stale' ELSE 'retry' END AS state FROM t GROUP BY document"""
)
def sync_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still to be sent: a failure leaves a mark and is tried again."""
    rows = load(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 4).alias("document"), "event_id", (F.col("event_type") != "error").alias("ok")).groupBy("document")
    state = F.when(F.max_by("ok", "event_id"), "synced").when(F.bool_or("ok"), "stale").otherwise("retry")
    return rows.agg(F.max(F.when(F.col("ok"), F.col("event_id"))).alias("synced_by"), F.count_if(~F.col("ok")).alias("n_failed"), state.alias("state"))


@C.query(
    """WITH i AS (SELECT sha256(text) AS sha256, doc_id, doc_id = min(doc_id) OVER (PARTITION BY sha256(text)) AS first, length(text) < 80 AS needs_ocr, doc_id % 2 = 0 AS has_ocr, doc_id % 5 <> 0 AS pending FROM documents)
SELECT doc_id, sha256, CASE WHEN first THEN 'parse' WHEN pending AND needs_ocr AND has_ocr THEN 'reparse' ELSE 'skip' END AS action FROM i"""
)
def reingest_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same content again changes nothing, unless it is pending, needs OCR, and OCR came with it. The least id of a content is an aggregate
    joined back, so that content which very many documents share is summed before it is shuffled and may be split when joined."""
    sha = F.sha2("text", 256)
    rows = load(spark, sf_dir, "documents").select("doc_id", sha.alias("sha256"), (F.length("text") < 80).alias("needs_ocr"))
    least = rows.groupBy(F.col("sha256").alias("content")).agg(F.min("doc_id").alias("first"))
    rows = rows.join(least, rows.sha256.eqNullSafe(least.content))
    again = (F.col("doc_id") % 5 != 0) & F.col("needs_ocr") & (F.col("doc_id") % 2 == 0)
    return rows.select("doc_id", "sha256", F.when(F.col("doc_id") == F.col("first"), "parse").when(again, "reparse").otherwise("skip").alias("action"))


@C.query(
    "SELECT run, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_failed, max(event_id) AS last_id FROM (SELECT *, event_id // 1000 AS run FROM events) GROUP BY run ORDER BY run DESC LIMIT 5"
)
def run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five runs with their counts."""
    rows = load(spark, sf_dir, "events").groupBy(F.floor(F.col("event_id") / 1000).alias("run"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("n_failed"), F.max("event_id").alias("last_id")).orderBy(F.desc("run")).limit(5)


@C.query(
    """WITH s AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN '%PDF-1.7' WHEN 1 THEN '  %PDF-1.4' ELSE substr(url, 1, 20) END AS content, CASE page_id % 2 WHEN 0 THEN 'Application/PDF; charset="UTF-8"' ELSE 'text/html' END AS header FROM pages)
SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'application/pdf' ELSE 'text/html' END AS content_type, CASE WHEN page_id % 2 = 0 THEN 'utf-8' END AS charset, page_id % 3 = 0 OR (page_id % 3 = 1 AND page_id % 2 = 0) AS is_pdf FROM s"""
)
def content_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A PDF by its first bytes, or by a mark near the start if the header says so too."""
    k = F.col("page_id")
    content = F.when(k % 3 == 0, F.lit("%PDF-1.7")).when(k % 3 == 1, F.lit("  %PDF-1.4")).otherwise(F.substring("url", 1, 20))
    rows = load(spark, sf_dir, "pages").select(k, content.cast("binary").alias("content"), F.when(k % 2 == 0, 'Application/PDF; charset="UTF-8"').otherwise("text/html").alias("header"))
    kind = W.content_type(F.col("header"))
    return rows.select("page_id", kind.alias("content_type"), W.charset(F.col("header")).alias("charset"), W.is_pdf(F.col("content"), kind).alias("is_pdf"))


QUERIES, ORACLE_SQL = C.queries, C.oracle_sql
