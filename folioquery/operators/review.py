"""Review and search: queues, summaries, verified exports, audit trails, public search. Orders stand for records
(P pending, F approved, O rejected) and their line items for fields."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import Catalog
from ..functions import vocabulary as V
from ..sources.tables import load, picked
from .records import zero_filled

C = Catalog()
STATUS = {"P": "pending", "F": "approved", "O": "rejected"}


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, source_id, status, parsed_at, needs_ocr)"""
    o = load(spark, sf_dir, "orders")
    status = reduce(lambda c, kv: c.when(F.col("o_orderstatus") == kv[0], kv[1]), STATUS.items(), F.when(F.lit(False), ""))
    return o.select(F.col("o_orderkey").alias("record_id"), F.col("o_custkey").alias("source_id"), status.alias("status"), F.to_date("o_orderdate").alias("parsed_on"), (F.col("o_orderpriority") == "5-LOW").alias("needs_ocr"))


def fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record_id, field_name, value, confidence): the current row of each field, the newest of its chain."""
    item = load(spark, sf_dir, "lineitem")
    rows = item.select(
        F.col("l_orderkey").alias("record_id"), picked(V.ALL_FIELDS, F.col("l_linenumber")).alias("field_name"), F.col("l_partkey").cast("string").alias("value"), F.round(1.0 - F.col("l_discount") * 5, 6).alias("confidence"),
        F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate").alias("turn"),
    )
    return rows.groupBy("record_id", "field_name").agg(F.max_by("value", "turn").alias("value"), F.max_by("confidence", "turn").alias("confidence"), F.count(F.lit(1)).alias("n_rows"))


RECORDS = """records AS (SELECT o_orderkey AS record_id, o_custkey AS source_id, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'approved' WHEN 'O' THEN 'rejected' END AS status, CAST(o_orderdate AS DATE) AS parsed_on, o_orderpriority = '5-LOW' AS needs_ocr FROM orders)"""
FIELDS = f"""field_rows AS (SELECT l_orderkey AS record_id, [{", ".join(repr(f) for f in V.ALL_FIELDS)}][l_linenumber % 7 + 1] AS field_name, CAST(l_partkey AS VARCHAR) AS value, round(1.0::DOUBLE - l_discount * 5, 6) AS confidence, (l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS turn FROM lineitem),
fields AS (SELECT record_id, field_name, max_by(value, turn) AS value, max_by(confidence, turn) AS confidence, count(*) AS n_rows FROM field_rows GROUP BY record_id, field_name)"""


@C.query(f"WITH {FIELDS} SELECT * FROM fields")
def current_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields(spark, sf_dir)


@C.query(
    f"""WITH {RECORDS}, {FIELDS} SELECT r.record_id, r.status, count(f.field_name) AS n_fields, min(f.confidence) AS lowest, 4 - count(CASE WHEN f.field_name IN ('go_number', 'go_date', 'department', 'subject') THEN 1 END) AS n_missing_core
FROM records r LEFT JOIN fields f USING (record_id) GROUP BY r.record_id, r.status"""
)
def record_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = F.count(F.when(F.col("field_name").isin(*V.CORE_FIELDS), 1))
    rows = records(spark, sf_dir).join(fields(spark, sf_dir), "record_id", "left")
    return rows.groupBy("record_id", "status").agg(F.count("field_name").alias("n_fields"), F.min("confidence").alias("lowest"), (4 - core).alias("n_missing_core"))


_LOWEST = f"""{RECORDS}, {FIELDS}, lowest AS (SELECT record_id, min(confidence) AS lowest FROM fields GROUP BY record_id),
queue AS (SELECT r.*, l.lowest FROM records r LEFT JOIN lowest l USING (record_id) WHERE r.status = 'pending')"""


def pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    lowest = fields(spark, sf_dir).groupBy("record_id").agg(F.min("confidence").alias("lowest"))
    return records(spark, sf_dir).where("status = 'pending'").join(lowest, "record_id", "left")


@C.query(f"WITH {_LOWEST} SELECT record_id, coalesce(lowest, 0) AS lowest FROM queue ORDER BY coalesce(lowest, 0), record_id LIMIT 50")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least sure pending records first; one without fields counts as 0."""
    rows = pending(spark, sf_dir).select("record_id", F.coalesce("lowest", F.lit(0.0)).alias("lowest"))
    return rows.orderBy("lowest", "record_id").limit(50)


@C.query(
    f"""WITH {_LOWEST}, failed AS (SELECT DISTINCT l_orderkey AS record_id FROM lineitem WHERE l_returnflag = 'R'),
typed AS (SELECT 'ocr' AS queue, record_id FROM queue WHERE needs_ocr UNION ALL SELECT 'metadata', record_id FROM queue WHERE lowest < 0.7 AND NOT needs_ocr
UNION ALL SELECT 'failure', record_id FROM queue SEMI JOIN failed USING (record_id) UNION ALL SELECT 'extraction', record_id FROM queue) SELECT * FROM typed"""
)
def typed_queues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record may wait in several queues."""
    rows = pending(spark, sf_dir)
    failed = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("record_id"))
    parts = {"ocr": rows.where("needs_ocr"), "metadata": rows.where("lowest < 0.7 and not needs_ocr"), "failure": rows.join(failed, "record_id", "left_semi"), "extraction": rows}
    return reduce(DataFrame.unionByName, [r.select(F.lit(q).alias("queue"), "record_id") for q, r in parts.items()])


@C.query(f"WITH {_LOWEST} SELECT count(*) FILTER (needs_ocr) AS ocr, count(*) FILTER (lowest < 0.7 AND NOT needs_ocr) AS metadata, count(*) AS extraction FROM queue")
def queue_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pending(spark, sf_dir).agg(F.count_if("needs_ocr").alias("ocr"), F.count_if((F.col("lowest") < 0.7) & ~F.col("needs_ocr")).alias("metadata"), F.count(F.lit(1)).alias("extraction"))


@C.query(f"WITH {RECORDS} SELECT s.status, count(r.record_id) AS n FROM (VALUES ('pending'), ('approved'), ('rejected'), ('withdrawn')) s(status) LEFT JOIN records r USING (status) GROUP BY s.status")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = records(spark, sf_dir).groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    return zero_filled(counts, "status", ("pending", "approved", "rejected", "withdrawn"))


@C.query(
    f"""WITH {RECORDS}, {FIELDS} SELECT r.record_id, count(*) AS n_fields, string_agg(f.field_name || '=' || f.value, ';' ORDER BY f.field_name) AS fields
FROM records r JOIN fields f USING (record_id) WHERE r.status = 'approved' GROUP BY r.record_id"""
)
def verified_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved records with their fields, nested; shown flat for comparison."""
    rows = records(spark, sf_dir).where("status = 'approved'").join(fields(spark, sf_dir), "record_id")
    nested = rows.groupBy("record_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", F.struct("value", "confidence")))).alias("fields"))
    shown = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.concat(e["key"], F.lit("="), e["value"]["value"]))
    return nested.select("record_id", F.size("fields").cast("bigint").alias("n_fields"), F.array_join(shown, ";").alias("fields"))


@C.query(
    f"""WITH {RECORDS}, {FIELDS}, o AS (SELECT record_id, sum(CAST(round(confidence * 1000000) AS BIGINT)) AS total, count(*) AS n FROM fields GROUP BY record_id)
SELECT r.status, count(*) AS n_records, CAST(coalesce(sum(o.n), 0) AS BIGINT) AS n_fields, CAST(coalesce(sum(o.total), 0) AS BIGINT) AS total FROM records r LEFT JOIN o USING (record_id) GROUP BY r.status"""
)
def backup_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Review decisions with their fields as an array, summed for comparison."""
    held = fields(spark, sf_dir).groupBy("record_id").agg(F.collect_list(F.struct("field_name", "value", "confidence")).alias("held"))
    rows = records(spark, sf_dir).join(held, "record_id", "left")
    micro = F.aggregate("held", F.lit(0).cast("bigint"), lambda a, x: a + F.round(x["confidence"] * 1000000).cast("bigint"))
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum(F.when(F.col("held").isNotNull(), F.size("held")).cast("bigint")), F.lit(0)).alias("n_fields"), F.coalesce(F.sum(micro), F.lit(0)).alias("total"))


def search(rows: DataFrame, **wanted: Column | None) -> DataFrame:
    """Rows that meet every condition given; conditions that are None do not count."""
    return rows.where(reduce(lambda a, b: a & b, [c for c in wanted.values() if c is not None], F.lit(True)))


_PUBLIC = """public AS (SELECT o_orderkey AS record_id, c_name AS source, c_mktsegment AS department, n_name AS district, CAST(o_orderdate AS DATE) AS dated, year(o_orderdate) AS year FROM orders
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderstatus = 'F')"""


def public(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved records alone: what is pending or rejected is as if it did not exist."""
    o = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return rows.select(F.col("o_orderkey").alias("record_id"), F.col("c_name").alias("source"), F.col("c_mktsegment").alias("department"), F.col("n_name").alias("district"), F.to_date("o_orderdate").alias("dated"), F.year("o_orderdate").cast("bigint").alias("year"))


@C.query(f"WITH {_PUBLIC} SELECT record_id, source, department, district, dated, year, count(*) OVER () AS total FROM public WHERE source ILIKE '%000001%' AND year >= 1996")
def public_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search(public(spark, sf_dir), text=F.col("source").ilike("%000001%"), since=F.col("year") >= 1996, district=None)
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    return rows.crossJoin(F.broadcast(total))  # one row


@C.query(f"WITH {_PUBLIC} SELECT record_id, department, district FROM public ORDER BY record_id DESC LIMIT 20 OFFSET 40")
def public_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return public(spark, sf_dir).select("record_id", "department", "district").orderBy(F.desc("record_id")).offset(40).limit(20)


@C.query(
    f"""WITH {_PUBLIC} SELECT 'department' AS kind, department AS value FROM public GROUP BY department UNION ALL SELECT 'district', district FROM public GROUP BY district UNION ALL SELECT 'year', CAST(year AS VARCHAR) FROM public GROUP BY year"""
)
def filter_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = public(spark, sf_dir).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("value")) for k in ("department", "district", "year")])).alias("o"))
    return one.select("o.kind", "o.value").distinct()


@C.query(
    """WITH latest AS (SELECT l_orderkey, max_by(l_shipdate, (l_shipdate, l_partkey)) AS shipped FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey)
SELECT o_orderkey AS document_id, c_name AS source, coalesce(n_name, 'unknown') AS district, CAST(shipped AS DATE) AS shipped_on, coalesce(o_orderstatus, 'new') AS status
FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey AND n_regionkey <> 0 LEFT JOIN latest ON l_orderkey = o_orderkey WHERE year(o_orderdate) = 1997"""
)
def document_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with what is known of them; conditions of left joins stay in the join. The year is a range, so it can be pushed down."""
    o = load(spark, sf_dir, "orders").where("o_orderdate >= timestamp_ntz'1997-01-01' and o_orderdate < timestamp_ntz'1998-01-01'")
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation").where("n_regionkey <> 0")
    latest = load(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey, "left").join(latest, o.o_orderkey == latest.l_orderkey, "left")
    return rows.select(F.col("o_orderkey").alias("document_id"), F.col("c_name").alias("source"), F.coalesce("n_name", F.lit("unknown")).alias("district"), F.to_date("shipped").alias("shipped_on"), F.coalesce("o_orderstatus", F.lit("new")).alias("status"))


@C.query("SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events QUALIFY place <= 10")
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten entries of each actor."""
    by = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    return load(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.row_number().over(by).cast("bigint").alias("place")).where("place <= 10")


@C.query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 500) WHERE event_type = 'click'")
def audit_page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The filter comes after the limit: a page of the newest entries, then those of one kind."""
    return load(spark, sf_dir, "events").select("event_id", "event_type").orderBy(F.desc("event_id")).limit(500).where("event_type = 'click'")


@C.query(
    """SELECT e.event_id, e.user_id FROM events e WHERE (event_type, user_id) IN (VALUES ('click', 7), ('view', 7), ('purchase', 11), ('signup', 13)) """
)
def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of several entities in one pass: a semi-join on (kind, id)."""
    wanted = spark.sql("SELECT * FROM VALUES ('click', 7L), ('view', 7L), ('purchase', 11L), ('signup', 13L) AS w(event_type, user_id)")
    return load(spark, sf_dir, "events").join(F.broadcast(wanted), ["event_type", "user_id"], "left_semi").select("event_id", "user_id")


@C.query(
    """SELECT user_id, event_type, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS n, count(*) % 2 = 1 AS saved FROM events WHERE event_type IN ('click', 'view') GROUP BY user_id, event_type"""
)
def bookmark_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toggle is on after an odd number of presses."""
    rows = load(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view")).groupBy("user_id", "event_type")
    n = F.count(F.lit(1))
    return rows.agg(F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), n.alias("n"), (n % 2 == 1).alias("saved"))


@C.query(
    f"""WITH {RECORDS}, {FIELDS}, wide AS (SELECT record_id, max(CASE field_name WHEN 'go_number' THEN value END) AS go_number, max(CASE field_name WHEN 'subject' THEN value END) AS subject FROM fields GROUP BY record_id)
SELECT e.event_id, e.user_id, w.go_number, w.subject FROM events e JOIN records r ON r.record_id = e.event_id LEFT JOIN wide w ON w.record_id = r.record_id WHERE r.status = 'approved'"""
)
def recent_downloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Downloads with number and subject: one pivot of the fields, not a join for each."""
    wide = fields(spark, sf_dir).groupBy("record_id").pivot("field_name", ["go_number", "subject"]).agg(F.max("value"))
    e = load(spark, sf_dir, "events").select("event_id", "user_id")
    approved = records(spark, sf_dir).where("status = 'approved'").select("record_id")
    return e.join(approved, e.event_id == approved.record_id).join(wide, "record_id", "left").select("event_id", "user_id", "go_number", "subject")


@C.query(
    f"""WITH {RECORDS}, {FIELDS}, core AS (SELECT record_id, count(DISTINCT field_name) AS n FROM fields WHERE field_name IN ('go_number', 'go_date', 'department', 'subject') GROUP BY record_id)
SELECT r.record_id, CAST(4 - coalesce(c.n, 0) AS BIGINT) AS n_missing FROM records r LEFT JOIN core c USING (record_id) WHERE r.status = 'approved' AND coalesce(c.n, 0) < 4"""
)
def approvals_incomplete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved records that lack core fields, which only an override may approve."""
    core = fields(spark, sf_dir).where(F.col("field_name").isin(*V.CORE_FIELDS)).groupBy("record_id").agg(F.countDistinct("field_name").alias("n"))
    rows = records(spark, sf_dir).where("status = 'approved'").join(core, "record_id", "left")
    return rows.select("record_id", (4 - F.coalesce("n", F.lit(0))).cast("bigint").alias("n_missing")).where("n_missing > 0")


@C.query(
    """WITH e AS (SELECT event_id, user_id, event_type, lag(event_type) OVER w AS before, lead(event_id) OVER w AS superseded_by FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, user_id, before, event_type AS after, superseded_by FROM e WHERE before IS NULL OR before <> event_type"""
)
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes with the value before and after; setting the value that holds is no change."""
    by = Window.partitionBy("user_id").orderBy("event_id")
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", F.lag("event_type").over(by).alias("before"), F.col("event_type").alias("after"), F.lead("event_id").over(by).alias("superseded_by"))
    return rows.where("before is null or before <> after")


@C.query(
    """WITH d AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'a' WHEN lang = 'fr' THEN 'b' WHEN lang = 'de' THEN 'c' ELSE 'other' END AS bucket FROM documents),
g AS (SELECT bucket, count(*) AS n FROM d SEMI JOIN labels USING (doc_id) GROUP BY bucket)
SELECT doc_id, bucket, CASE WHEN bucket = 'other' THEN 10000 ELSE coalesce(n, 0) END AS weight FROM d ANTI JOIN labels USING (doc_id) LEFT JOIN g USING (bucket) ORDER BY weight, doc_id LIMIT 30"""
)
def golden_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents not annotated yet, of the least covered bucket first."""
    bucket = F.when(F.col("lang") == "en", "a").when(F.col("lang") == "fr", "b").when(F.col("lang") == "de", "c").otherwise("other")
    docs, labels = load(spark, sf_dir, "documents").select("doc_id", bucket.alias("bucket")), load(spark, sf_dir, "labels").select("doc_id")
    counts = docs.join(labels, "doc_id", "left_semi").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    rows = docs.join(labels, "doc_id", "left_anti").join(counts, "bucket", "left")
    weight = F.when(F.col("bucket") == "other", F.lit(10000)).otherwise(F.coalesce("n", F.lit(0))).cast("bigint")
    return rows.select("doc_id", "bucket", weight.alias("weight")).orderBy("weight", "doc_id").limit(30)


QUERIES, ORACLE_SQL = C.queries, C.oracle_sql
