"""Administration: categories of documents, the filtered library, decisions with their guards, clean-ups with what depends on them,
resets, adapters by name, columns added to old tables. Orders stand for documents and records, entries of events for actions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import Catalog
from ..functions import text as T
from ..functions import vocabulary as V
from ..sources.tables import load, order_facts, order_pages, picked
from ..streaming.streams import shared_folder
from . import extraction
from .extraction import FACTS
from .operations import _SCOPE, STAGES, scope, with_now
from .records import flags, stored
from .review import FIELDS, fields
from .web import anchors, counters, links, listing_rows
from .workbench import _bucket

C = Catalog()


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


# categories


def categorized(pages: DataFrame, extractions: DataFrame, registered: DataFrame) -> DataFrame:
    """A category for each document: pages(doc_id, page, text), extractions(doc_id, needs_ocr, ocr_applied, page_count), registered(doc_id, department) of its source.

    The bucket follows the department that the text names, if its confidence is 0.5 or more, else that of the source.
    """
    named = extraction.winners(extraction.candidates(pages, ("department",))).where("final >= 0.5").select("doc_id", F.col("normalized").alias("named"))
    tamil, english = T.script_counts(F.col("text"), "஀-௿")
    seen = pages.groupBy("doc_id").agg(*flags(), T.language(F.sum(tamil), F.sum(english), ("tamil", "english")).alias("language"))  # one pass over all pages
    out = extractions.join(registered, "doc_id").join(seen, "doc_id", "left").join(named, "doc_id", "left")
    return out.select(
        "doc_id", F.when(F.col("needs_ocr") | F.col("ocr_applied"), "scanned").otherwise("digital").alias("text_type"), F.coalesce("language", F.lit("unknown")).alias("language"),
        F.coalesce("annexure_heavy", F.lit(False)).alias("annexure_heavy"), F.coalesce("table_heavy", F.lit(False)).alias("table_heavy"), T.bucket(F.coalesce("named", "department")).alias("bucket"), "page_count",
    )


_BUCKETS = f"[{', '.join(repr(_bucket(d)) for d in V.DEPARTMENTS)}]"


@C.query(
    f"""WITH {FACTS}, c AS (SELECT doc_id, doc_id % 6 = 0 OR doc_id % 10 = 0 AS scanned, 2 + CASE WHEN doc_id % 3 < 2 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 < 2 OR doc_id % 7 < 2 THEN 1 ELSE 0 END + CASE WHEN doc_id % 17 = 0 THEN 4 ELSE 0 END AS page_count FROM facts)
SELECT doc_id, CASE WHEN scanned THEN 'scanned' ELSE 'digital' END AS text_type, CASE doc_id % 7 WHEN 0 THEN 'tamil' WHEN 1 THEN 'mixed' ELSE 'english' END AS language, page_count > 5 OR doc_id % 5 = 0 AS annexure_heavy, doc_id % 3 = 0 AS table_heavy,
  {_BUCKETS}[CASE WHEN doc_id % 2 = 0 THEN doc_id % {len(V.DEPARTMENTS)} ELSE (doc_id + 7) % {len(V.DEPARTMENTS)} END + 1] AS bucket, CAST(page_count AS BIGINT) AS page_count FROM c"""
)
def document_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order texts with tables, annexures and Tamil pages; every second one names no department, or only in what it cites."""
    facts, k = order_facts(spark, sf_dir), F.col("doc_id")
    orders = order_pages(facts).where("doc_id % 2 = 0 or page = 2")
    letters = facts.where("doc_id % 2 = 1").select(k, F.lit(1).alias("page"), F.when(k % 4 == 1, "Read:\n     1. Finance Department letter.\n").otherwise("A letter.\n").alias("text"))
    table = F.when(k % 3 < 2, F.repeat(F.lit("alpha  beta\tgamma\n"), F.when(k % 3 == 0, 6).otherwise(5)))
    said = F.concat(F.when(k % 5 == 0, "ANNEXURE I\nannexure II\n").when(k % 5 == 1, "Annexure\n").otherwise(""), F.repeat(F.lit("அ"), F.when(k % 7 == 0, 8000).when(k % 7 == 1, 150).otherwise(0)))
    more = F.array_compact(F.concat(F.array(table, F.when(said != "", said)), F.array_repeat(F.lit("x"), F.when(k % 17 == 0, 4).otherwise(0))))
    added = facts.select(k, F.posexplode(more).alias("at", "text")).select("doc_id", (F.col("at") + 3).alias("page"), "text")
    pages = _union([orders, letters, added])
    extracted = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count")).select(k, (k % 6 == 0).alias("needs_ocr"), (k % 10 == 0).alias("ocr_applied"), "page_count")
    return categorized(pages, extracted, facts.select(k, picked(V.DEPARTMENTS, k + 7).alias("department")))


_PAGE_ONE = """E'GOVERNMENT OF TAMIL NADU\\n\\nABSTRACT\\n\\n' || department || E' Department - Works of the year - Orders issued.\\n\\n----------\\n\\n' || upper(department) || E' (AB-II) DEPARTMENT\\n\\n' || line || '          Dated: ' || strftime(dated, '%d.%m.%Y') || E'\\n\\nRead:\\n' ||
CASE form WHEN 3 THEN E'     1. Letter of the Director.\\n' ELSE E'     1. G.O.(Ms) No.11, Finance (BG.I) Department, Dated: 04.01.1990.\\n' END || E'\\nORDER:\\n\\n1. The Government sanction a sum of Rs.' || amount || ' lakh under the ' || scheme || ' Scheme in ' || district || E' District.\\n'"""


@C.query(
    f"""WITH {FACTS}, n AS (SELECT *, CASE form WHEN 0 THEN 'G.O.(Ms) No.' WHEN 1 THEN 'G.O. No.' WHEN 2 THEN 'G.0.{{Rt.) No.' WHEN 3 THEN 'Order No. ' ELSE 'G.O.(D).No.' END || number AS line FROM facts),
t AS (SELECT doc_id, line, {_PAGE_ONE} AS text FROM n), s AS (SELECT *, instr(text, line) - 1 AS start FROM t)
SELECT doc_id, line AS value, trim(regexp_replace(substr(text, greatest(start - 60, 0) + 1, start + length(line) + 120 - greatest(start - 60, 0)), '\\s+', ' ', 'g')) AS evidence FROM s"""
)
def order_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winning order number as it was read, with the text around it."""
    return extraction.winners(extraction.candidates(order_pages(order_facts(spark, sf_dir)), ("go_number",))).select("doc_id", "value", "evidence")


@C.query(
    "SELECT o_orderkey AS doc_id, o_orderkey % 2000 || '.00' AS normalized, round(least(0.7::DOUBLE + least(length(CAST(o_orderkey % 2000 AS VARCHAR)) / 12.0::DOUBLE, 0.25::DOUBLE), 0.95::DOUBLE), 4) AS confidence FROM orders WHERE o_orderkey % 2000 > 0"
)
def budget_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small sums: the more digits, the surer, up to a bound; a sum of nothing is none."""
    text = F.concat(F.lit("Rs."), (F.col("o_orderkey") % 2000).cast("string"), F.lit("/- only"))
    pages = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), text.alias("text"))
    return extraction.candidates(pages, ("budget",)).select("doc_id", "normalized", "confidence")


# the library


def list_documents(
    documents: DataFrame, sources: DataFrame, discovered: DataFrame, records: DataFrame, numbers: DataFrame, categories: DataFrame,
    source_id: int | None = None, search: str | None = None, department: str | None = None, year: int | None = None, language: str | None = None, status: str | None = None, limit: int = 500,
) -> DataFrame:
    """Documents, newest first, that meet every filter given. Each extraction of a document has a row; status is the review's, else that of discovery.

    documents(document_id, source_id, file_name, downloaded_at), sources(source_id, source_name, department), discovered(document_id, discovery_status),
    records(document_id, record_id, review_status), numbers(record_id, go_number), categories(document_id, language).
    """
    d = documents if source_id is None else documents.where(F.col("source_id") == source_id)
    if year is not None:  # a range, which reaches the scan
        d = d.where(f"downloaded_at >= timestamp_ntz'{year}-01-01' and downloaded_at < timestamp_ntz'{year + 1}-01-01'")
    s = sources if department is None else sources.where(F.col("department") == department)
    rows = d.join(s, "source_id").join(discovered, "document_id", "left").join(records, "document_id", "left").join(numbers, "record_id", "left").join(categories, "document_id", "left")
    if search is not None:
        plain = "%" + search.replace("\\", "\\\\") + "%"
        rows = rows.where(F.col("file_name").ilike(plain) | F.col("go_number").ilike(plain))
    if language is not None:
        rows = rows.where(F.col("language") == language)
    if status is not None:
        rows = rows.where(F.coalesce("review_status", "discovery_status") == status)
    return rows.orderBy(F.desc("downloaded_at"), F.desc("document_id"), F.desc_nulls_last("record_id")).limit(limit)


#: name: (filters of list_documents, the same in SQL)
_FILTERS: dict[str, tuple[dict, str]] = {
    "none": ({}, "true"),
    "source": ({"source_id": 7}, "source_id = 7"),
    "search": ({"search": "GO-11"}, "file_name ILIKE '%GO-11%' OR go_number ILIKE '%GO-11%'"),
    "number": ({"search": "99"}, "file_name ILIKE '%99%' OR go_number ILIKE '%99%'"),
    "department": ({"department": "BUILDING"}, "department = 'BUILDING'"),
    "year": ({"year": 1997}, "year(downloaded_at) = 1997"),
    "language": ({"language": "tamil"}, "language = 'tamil'"),
    "reviewed": ({"status": "approved"}, "coalesce(review_status, discovery_status) = 'approved'"),
    "not reviewed": ({"status": "parsed"}, "coalesce(review_status, discovery_status) = 'parsed'"),
    "three": ({"year": 1995, "language": "english", "status": "rejected"}, "year(downloaded_at) = 1995 AND language = 'english' AND coalesce(review_status, discovery_status) = 'rejected'"),
}


@C.query(
    f"""WITH {FIELDS}, d AS (SELECT o_orderkey AS document_id, o_custkey AS source_id, 'go-' || o_orderkey || '.pdf' AS file_name, o_orderdate AS downloaded_at FROM orders),
r AS (SELECT o_orderkey AS document_id, o_orderkey AS record_id, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS review_status FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, -o_orderkey, 'rejected' FROM orders WHERE o_orderkey % 10 = 1),
l AS (SELECT d.document_id, file_name, downloaded_at, d.source_id, c_mktsegment AS department, CASE WHEN d.document_id % 4 < 3 THEN ['new', 'downloaded', 'parsed'][d.document_id % 4 + 1] END AS discovery_status, r.record_id, r.review_status, f.value AS go_number, CASE d.document_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'tamil' ELSE 'english' END AS language
  FROM d JOIN customer ON c_custkey = d.source_id LEFT JOIN r USING (document_id) LEFT JOIN fields f ON f.record_id = r.record_id AND f.field_name = 'go_number')
"""
    + " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{name}' AS filter, document_id, file_name, department, discovery_status, record_id, review_status, go_number, language FROM l WHERE {where} ORDER BY downloaded_at DESC, document_id DESC, record_id DESC NULLS LAST LIMIT 500)"
        for name, (_, where) in _FILTERS.items()
    )
)
def library_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the library for each filter, and for several at once."""
    o, k = load(spark, sf_dir, "orders"), F.col("document_id")
    docs = o.select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("source_id"), F.concat(F.lit("go-"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("file_name"), F.col("o_orderdate").alias("downloaded_at"))
    found = docs.where(k % 4 < 3).select(k, picked(("new", "downloaded", "parsed", ""), k % 4).alias("discovery_status"))
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected")
    key = F.col("o_orderkey").alias("document_id")
    records = o.where("o_orderkey % 3 <> 0").select(key, F.col("o_orderkey").alias("record_id"), status.alias("review_status"))
    again = o.where("o_orderkey % 10 = 1").select(key, (-F.col("o_orderkey")).alias("record_id"), F.lit("rejected").alias("review_status"))
    numbers = fields(spark, sf_dir).where("field_name = 'go_number'").select("record_id", F.col("value").alias("go_number"))
    sources = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id"), F.col("c_name").alias("source_name"), F.col("c_mktsegment").alias("department"))
    language = docs.where(k % 5 > 0).select(k, F.when(k % 5 == 1, "tamil").otherwise("english").alias("language"))
    shown = ("document_id", "file_name", "department", "discovery_status", "record_id", "review_status", "go_number", "language")
    page = lambda name, wanted: list_documents(docs, sources, found, records.unionByName(again), numbers, language, **wanted).select(F.lit(name).alias("filter"), *shown)
    return _union([page(name, wanted) for name, (wanted, _) in _FILTERS.items()])


# decisions and edits


def decided(log: DataFrame) -> DataFrame:
    """log with verdict, before and after, in the order of event_id within each record.

    log(event_id, record, action, reviewer, field, value, page, reason, override, had): had is what field held at first, for approvals whether core fields
    were lacking that corrections may fill (lacks, an array of field names). A refused action changes nothing that later ones see.
    """
    mine = Window.partitionBy("record").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    field = Window.partitionBy("record", "field").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    signed, corrects = F.col("reviewer").isNotNull(), F.col("action") == "correct"
    able = corrects & signed & F.col("field").isin(*V.ALL_FIELDS)
    placed = F.coalesce(F.max(able & F.col("page").isNotNull()).over(field), F.lit(False)) | F.col("had").isNotNull() | F.col("page").isNotNull()
    rows = log.withColumn("_set", able & placed)
    rows = rows.withColumn("_was", F.coalesce(F.last(F.when(F.col("_set"), F.col("value")), ignorenulls=True).over(field), "had"))
    rows = rows.withColumn("_filled", F.collect_set(F.when(F.col("_set"), F.col("field"))).over(mine))
    short = F.size(F.array_except("lacks", "_filled")) > 0
    verdict = (
        F.when(corrects & ~F.col("field").isin(*V.ALL_FIELDS), "unknown field").when(~signed, "no reviewer").when(corrects & ~F.col("_set"), "no page")
        .when(corrects & F.col("_was").eqNullSafe(F.col("value")), "unchanged").when((F.col("action") == "approve") & short & ~F.col("override"), "fields missing")
        .when((F.col("action") == "reject") & F.col("reason").isNull(), "no reason").otherwise("done")
    )
    rows = rows.withColumn("verdict", verdict)
    status = F.when((F.col("verdict") == "done") & ~corrects, F.when(F.col("action") == "approve", "approved").otherwise("rejected"))
    rows = rows.withColumn("_status", status)
    held = F.coalesce(F.last("_status", ignorenulls=True).over(mine), F.lit("pending"))
    done = F.col("verdict") == "done"
    rows = rows.withColumn("before", F.when(done, F.when(corrects, F.col("_was")).otherwise(held))).withColumn("after", F.when(done, F.coalesce("_status", "value")))
    return rows.drop("_set", "_was", "_filled", "_status")


def decision_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    action = F.when(kind.isin("click", "view"), "correct").when(kind.isin("purchase", "signup"), "approve").otherwise("reject")
    corrects = kind.isin("click", "view")
    name = F.when(corrects, F.when(k % 11 == 0, "colour").when(k % 2 == 0, "subject").otherwise("district"))
    had = F.when(corrects & ((name == "district") | ((name == "subject") & (F.floor(k / 6) % 3 != 0))), F.lit("0"))
    return load(spark, sf_dir, "events").select(
        k, F.floor(k / 6).alias("record"), action.alias("action"), F.when(k % 9 != 0, F.col("user_id")).alias("reviewer"), name.alias("field"), F.when(corrects, (k % 4).cast("string")).alias("value"), F.when(k % 5 != 0, F.lit(1)).alias("page"),
        F.when(k % 7 != 0, F.lit("why")).alias("reason"), (kind == "signup").alias("override"), had.alias("had"), F.when(F.floor(k / 6) % 3 == 0, F.array(F.lit("subject"))).otherwise(F.array().cast("array<string>")).alias("lacks"),
    )


@C.query(
    """WITH a AS (SELECT event_id AS id, event_id // 6 AS record, event_type IN ('click', 'view') AS corrects, CASE WHEN event_type IN ('click', 'view') THEN CASE WHEN event_id % 11 = 0 THEN 'colour' WHEN event_id % 2 = 0 THEN 'subject' ELSE 'district' END END AS field,
  CAST(event_id % 4 AS VARCHAR) AS value, event_id % 9 <> 0 AS signed, event_id % 5 <> 0 AS paged, event_id % 7 <> 0 AS reasoned, event_type AS kind, (event_id // 6) % 3 = 0 AS lacking FROM events),
sets AS (SELECT s.* FROM a s WHERE corrects AND signed AND field <> 'colour' AND (paged OR field = 'district' OR NOT lacking OR EXISTS (SELECT 1 FROM a e WHERE e.record = s.record AND e.field = s.field AND e.id < s.id AND e.signed AND e.paged))),
w AS (SELECT a.*, EXISTS (SELECT 1 FROM sets s WHERE s.id = a.id) AS ok, coalesce((SELECT max_by(s.value, s.id) FROM sets s WHERE s.record = a.record AND s.field = a.field AND s.id < a.id), CASE WHEN a.field = 'district' OR NOT a.lacking THEN '0' END) AS was,
  lacking AND NOT EXISTS (SELECT 1 FROM sets s WHERE s.record = a.record AND s.field = 'subject' AND s.id < a.id) AS short FROM a),
v AS (SELECT *, CASE WHEN corrects AND field = 'colour' THEN 'unknown field' WHEN NOT signed THEN 'no reviewer' WHEN corrects AND NOT ok THEN 'no page' WHEN corrects AND was IS NOT DISTINCT FROM value THEN 'unchanged' WHEN kind = 'purchase' AND short THEN 'fields missing' WHEN NOT corrects AND kind NOT IN ('purchase', 'signup') AND NOT reasoned THEN 'no reason' ELSE 'done' END AS verdict FROM w),
n AS (SELECT *, CASE WHEN verdict = 'done' AND NOT corrects THEN CASE WHEN kind IN ('purchase', 'signup') THEN 'approved' ELSE 'rejected' END END AS status FROM v)
SELECT id AS event_id, record, verdict, CASE WHEN verdict <> 'done' THEN NULL WHEN corrects THEN was ELSE coalesce((SELECT max_by(p.status, p.id) FROM n p WHERE p.record = n.record AND p.id < n.id AND p.status IS NOT NULL), 'pending') END AS before, CASE WHEN verdict = 'done' THEN coalesce(status, value) END AS after FROM n"""
)
def record_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections, approvals and rejections: those that a guard refuses, those that change nothing, and the value before and after the rest."""
    return decided(decision_log(spark, sf_dir)).select("event_id", "record", "verdict", "before", "after")


PRIORITY = ("Low", "Normal", "High", "Critical")


def edited(log: DataFrame, allowed: tuple[str, ...] = PRIORITY) -> DataFrame:
    """log(event_id, name, action, value) of a registry with verdict, before and after: names are unique, values of a closed list, and only what exists is edited."""
    past = Window.partitionBy("name").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    fits = F.coalesce(F.col("value").isin(*allowed), F.lit(False))
    exists = F.coalesce(F.max(fits & (F.col("action") == "create")).over(past), F.lit(False))
    verdict = F.when(~fits, "value not allowed").when((F.col("action") == "create") & exists, "name exists").when((F.col("action") == "edit") & ~exists, "no such name").otherwise("done")
    rows = log.withColumn("verdict", verdict)
    done = F.col("verdict") == "done"
    before = F.last(F.when(done, F.col("value")), ignorenulls=True).over(past)
    return rows.withColumn("before", F.when(done, before)).withColumn("after", F.when(done, F.col("value")))


@C.query(
    """WITH a AS (SELECT event_id AS id, user_id AS name, event_type = 'signup' AS creates, ['Low', 'Normal', 'High', 'Critical', 'Urgent'][event_id % 5 + 1] AS value FROM events WHERE event_type IN ('signup', 'click', 'view')),
f AS (SELECT name, min(id) AS born FROM a WHERE creates AND value <> 'Urgent' GROUP BY name),
v AS (SELECT a.*, CASE WHEN value = 'Urgent' THEN 'value not allowed' WHEN creates AND born < id THEN 'name exists' WHEN NOT creates AND (born IS NULL OR born > id) THEN 'no such name' ELSE 'done' END AS verdict FROM a LEFT JOIN f USING (name)),
d AS (SELECT id, lag(value) OVER (PARTITION BY name ORDER BY id) AS before, value AS after FROM v WHERE verdict = 'done')
SELECT id AS event_id, name, verdict, before, after FROM v LEFT JOIN d USING (id)"""
)
def registry_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").where(F.col("event_type").isin("signup", "click", "view"))
    action = F.when(F.col("event_type") == "signup", "create").otherwise("edit")
    log = events.select("event_id", F.col("user_id").alias("name"), action.alias("action"), picked((*PRIORITY, "Urgent"), F.col("event_id")).alias("value"))
    return edited(log).select("event_id", "name", "verdict", "before", "after")


# clean-up and reset


def cleaned(records: DataFrame, fields: DataFrame, log: DataFrame, extractions: DataFrame) -> dict[str, DataFrame]:
    """The tables without all but the newest pending record of each document, and without what depended on those; audit names what went.

    records(record, document, extraction, status), fields(record, ...), log(record, ...) which only forgets the record, extractions(extraction), which stay while a record needs them.
    """
    waiting = records.where("status = 'pending'")
    groups = waiting.groupBy("document").agg(F.max("record").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    gone = waiting.join(groups, "document").where("record <> kept").select("record", "document", "kept", "extraction")
    left = records.join(gone.select("record"), "record", "left_anti")
    unused = gone.select("extraction").distinct().join(left, "extraction", "left_anti")
    forgotten = log.join(gone.select("record", F.lit(True).alias("_gone")), "record", "left")
    return {
        "records": left,
        "fields": fields.join(gone.select("record"), "record", "left_anti"),
        "log": forgotten.withColumn("record", F.when(F.col("_gone").isNull(), F.col("record"))).drop("_gone"),
        "extractions": extractions.join(unused, "extraction", "left_anti"),
        "audit": gone.groupBy("document", "kept").agg(F.array_join(F.transform(F.sort_array(F.collect_list("record")), lambda x: x.cast("string")), ",").alias("removed")),
    }


_GONE = """rec AS (SELECT o_orderkey AS record, o_custkey AS document, o_orderkey // 2 AS extraction, o_orderstatus AS status FROM orders),
kept AS (SELECT document, max(record) AS kept FROM rec WHERE status = 'P' GROUP BY document HAVING count(*) > 1),
gone AS (SELECT * FROM rec JOIN kept USING (document) WHERE status = 'P' AND record <> kept)"""


def _cleaned(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    o, k = load(spark, sf_dir, "orders"), F.col("o_orderkey")
    records = o.select(k.alias("record"), F.col("o_custkey").alias("document"), F.floor(k / 2).alias("extraction"), F.when(F.col("o_orderstatus") == "P", "pending").otherwise("decided").alias("status"))
    held = load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), "l_linenumber")
    log = load(spark, sf_dir, "events").select(F.col("event_id").alias("record"), F.col("event_id").alias("entry"))
    return cleaned(records, held, log, records.select("extraction").distinct())


@C.query(f"WITH {_GONE} SELECT document, kept, string_agg(CAST(record AS VARCHAR), ',' ORDER BY record) AS removed FROM gone GROUP BY document, kept")
def cleanup_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cleaned(spark, sf_dir)["audit"]


@C.query(
    f"""WITH {_GONE}, l AS (SELECT * FROM rec WHERE record NOT IN (SELECT record FROM gone))
SELECT 'records' AS part, count(*) AS n, CAST(sum(record) AS BIGINT) AS total FROM l UNION ALL SELECT 'fields', count(*), CAST(sum(l_orderkey) AS BIGINT) FROM lineitem WHERE l_orderkey NOT IN (SELECT record FROM gone)
UNION ALL SELECT 'log', count(*), CAST(sum(CASE WHEN event_id NOT IN (SELECT record FROM gone) THEN event_id END) AS BIGINT) FROM events UNION ALL SELECT 'extractions', count(*), CAST(sum(extraction) AS BIGINT) FROM (SELECT DISTINCT extraction FROM l)"""
)
def cleanup_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clean-up leaves of each table."""
    parts = _cleaned(spark, sf_dir)
    keys = {"records": "record", "fields": "record", "log": "record", "extractions": "extraction"}
    return _union([parts[p].agg(F.count(F.lit(1)).alias("n"), F.sum(key).alias("total")).select(F.lit(p).alias("part"), "n", "total") for p, key in keys.items()])


def reset(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after a reset: derived ones empty, discoveries back at what their archived file shows, nothing published."""
    out = {name: rows.where(F.lit(False)) if name in V.RESET else rows for name, rows in tables.items()}
    if "discovered_documents" in out:
        back = F.when(F.col("status").isin("parsed", "verified", "rejected"), "downloaded").otherwise(F.col("status"))
        out["discovered_documents"] = out["discovered_documents"].where("status <> 'new'").withColumns({"status": back, "first_crawl_run_id": F.lit(None).cast("bigint")})
    if "districts" in out:
        out["districts"] = out["districts"].withColumns({"status": F.when(F.col("status") == "PUBLISHED", F.col("certification_status")).otherwise(F.col("status")), "publication_status": F.lit("NOT_PUBLISHED")})
    if "departments" in out:
        out["departments"] = out["departments"].withColumns({"publication_status": F.lit("NOT_PUBLISHED"), "published_by": F.lit(None).cast("string"), "published_at": F.lit(None).cast("timestamp")})
    return out


_STATES = ("new", "downloaded", "parsed", "verified", "rejected")


@C.query(
    """SELECT 'discovered_documents' AS part, CASE WHEN doc_id % 5 IN (2, 3, 4) THEN 'downloaded' ELSE 'downloaded' END AS state, count(*) AS n FROM documents WHERE doc_id % 5 <> 0 GROUP BY 2
UNION ALL SELECT 'documents', 'kept', count(*) FROM documents UNION ALL SELECT 'districts', CASE WHEN n_nationkey % 3 = 0 THEN 'CERTIFIED' ELSE 'ACTIVE' END, count(*) FROM nation GROUP BY 2 UNION ALL SELECT 'go_records', 'kept', 0"""
)
def reset_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each table by state, after a reset."""
    docs, nations, n = load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "nation"), F.count(F.lit(1)).alias("n")
    tables = {
        "documents": docs, "go_records": load(spark, sf_dir, "orders").select("o_orderkey"),
        "discovered_documents": docs.select("doc_id", picked(_STATES, F.col("doc_id")).alias("status"), F.col("doc_id").alias("first_crawl_run_id")),
        "districts": nations.select("n_nationkey", F.when(F.col("n_nationkey") % 3 == 0, "PUBLISHED").otherwise("ACTIVE").alias("status"), F.lit("CERTIFIED").alias("certification_status"), F.lit("PUBLISHED").alias("publication_status")),
    }
    after = reset(tables)
    by_state = lambda part: after[part].groupBy(F.col("status").alias("state")).agg(n).select(F.lit(part).alias("part"), "state", "n")
    whole = lambda part: after[part].agg(n).select(F.lit(part).alias("part"), F.lit("kept").alias("state"), "n")
    return _union([by_state("discovered_documents"), whole("documents"), by_state("districts"), whole("go_records")])


@C.query(
    f"""WITH {_SCOPE}, g AS (SELECT n_nationkey AS district, CASE WHEN count(id) = 0 THEN 'PENDING' WHEN n_nationkey % 3 = 0 THEN 'CERTIFIED' WHEN bool_and(certification = 'CERTIFIED') THEN 'CERTIFIED' WHEN bool_or(certification IN ('CERTIFIED', 'PARTIALLY_CERTIFIED')) THEN 'PARTIALLY_CERTIFIED' WHEN bool_and(certification = 'FAILED') THEN 'FAILED' ELSE 'PENDING' END AS after FROM nation LEFT JOIN scope s ON s.district = n_nationkey GROUP BY n_nationkey),
b AS (SELECT *, CASE WHEN district % 2 = 0 THEN 'PENDING' ELSE 'CERTIFIED' END AS before, ['DISCOVERED', 'ACTIVE', 'CERTIFIED', 'PUBLISHED', 'RETIRED'][district % 5 + 1] AS stage FROM g)
SELECT district, before, after, CASE WHEN after = 'CERTIFIED' AND before <> 'CERTIFIED' AND district % 5 < 2 THEN 'CERTIFIED' ELSE stage END AS stage, before <> after AS audited FROM b"""
)
def certification_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Districts' certification anew; one that becomes certified moves forward to that stage, and never back."""
    k = F.col("district")
    held = scope(spark, sf_dir).withColumn("certification", F.when(k % 3 == 0, "CERTIFIED").otherwise(F.col("certification")))
    rows = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("district")).join(held, "district", "left").groupBy("district").agg(F.collect_set("certification").alias("have"))
    has = lambda s: F.array_contains("have", s)
    only = lambda s: has(s) & (F.size("have") == 1)
    after = F.when(only("CERTIFIED"), "CERTIFIED").when(has("CERTIFIED") | has("PARTIALLY_CERTIFIED"), "PARTIALLY_CERTIFIED").when(only("FAILED"), "FAILED").otherwise("PENDING")
    rows = rows.select(k, F.when(k % 2 == 0, "PENDING").otherwise("CERTIFIED").alias("before"), after.alias("after"), picked(STAGES, k).alias("stage"))
    early = F.col("stage").isin(*STAGES[: STAGES.index("CERTIFIED")])
    moved = F.when((F.col("after") == "CERTIFIED") & (F.col("before") != "CERTIFIED") & early, "CERTIFIED").otherwise(F.col("stage"))
    return rows.select(k, "before", "after", moved.alias("stage"), (F.col("before") != F.col("after")).alias("audited"))


# adapters and columns


def generic_links(pages: DataFrame) -> DataFrame:
    """(page_id, href, link_text, hints): every link of a page."""
    none = F.array().cast("array<struct<field:string,value:string>>")
    return anchors(pages).where("href <> ''").select("page_id", "href", "link_text", none.alias("hints"))


def portal_listing(pages: DataFrame) -> DataFrame:
    """The links of table rows with what the header says of them; pages without such rows are read as others are."""
    rows = listing_rows(pages).where("href <> ''").select("page_id", "href", "link_text", F.col("hints").cast("array<struct<field:string,value:string>>").alias("hints"))
    rest = pages.join(rows.select("page_id").distinct(), "page_id", "left_anti")
    return rows.unionByName(generic_links(rest))


Adapter = Callable[[DataFrame], DataFrame]
ADAPTERS: dict[str, Adapter] = {"generic_links": generic_links, "portal_listing": portal_listing}


def adapter(name: str) -> Adapter:
    if name not in ADAPTERS:
        raise LookupError(f"unknown adapter {name!r}; available: {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[name]


def adapted(pages: DataFrame) -> DataFrame:
    """Links of pages(page_id, url, html, adapter), each page read by the adapter it names; other names are read by none."""
    return _union([read(pages.where(F.col("adapter") == name)).withColumn("adapter", F.lit(name)) for name, read in ADAPTERS.items()])


@C.query(
    """SELECT o_orderkey AS page_id, CASE WHEN o_orderkey % 3 = 2 THEN 'generic_links' ELSE 'portal_listing' END AS adapter, '/go/' || o_orderkey || '.pdf' AS href, 'G.O. ' || o_orderkey AS link_text, CASE WHEN o_orderkey % 3 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS dated FROM orders
UNION ALL SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN 'generic_links' ELSE 'portal_listing' END, '/about', 'About', NULL FROM orders WHERE o_orderkey % 3 <> 0"""
)
def adapter_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a table, without one, and of a source with the other adapter."""
    k = F.col("o_orderkey")
    link = F.concat(F.lit('<a href="/go/'), k.cast("string"), F.lit('.pdf">G.O. '), k.cast("string"), F.lit("</a>"))
    table = F.concat(F.lit("<table><tr><th>Order</th><th>Date</th></tr><tr><td>"), link, F.lit("</td><td>"), F.to_date("o_orderdate").cast("string"), F.lit('</td></tr></table>'))
    html = F.concat(F.when(k % 3 != 1, table).otherwise(link), F.lit('<p><a href="/about">About</a></p>'))
    which = F.when(k % 3 == 2, "generic_links").otherwise("portal_listing")
    pages = load(spark, sf_dir, "orders").select(k.alias("page_id"), F.lit("https://example.com/list").alias("url"), html.alias("html"), which.alias("adapter"))
    dated = F.get(F.filter("hints", lambda z: z["field"] == "go_date"), F.lit(0))["value"]
    return adapted(pages).select("page_id", "adapter", "href", "link_text", dated.alias("dated"))



@C.query(
    """WITH o AS (SELECT o_orderkey AS k FROM orders) SELECT k AS page_id, k % 2 + 1 AS n_documents, k % 3 AS n_department, k % 4 AS n_listing, k % 5 AS n_document_pages, k % 6 AS n_rejected, k % 7 AS n_skipped, CAST(CASE WHEN k % 8 < 4 THEN 1 ELSE 0 END AS BIGINT) + k % 2 AS n_follow FROM o"""
)
def crawl_page_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a known number of links of each kind, counted by kind."""
    k = F.col("o_orderkey")

    def several(n: Column, href: Column, text: str) -> Column:
        one = lambda i: F.concat(F.lit('<a href="'), F.replace(href, F.lit("#N"), i.cast("string")), F.lit(f'">{text}</a>'))
        return F.array_join(F.transform(F.filter(F.sequence(F.lit(0), n.cast("int")), lambda i: i < n), one), " ")

    parts = [
        several(k % 2 + 1, F.lit("/files/#N.pdf"), "file"), several(k % 3, F.lit("/godept_list.php?dep_id=#N"), "dept"), several(k % 4, F.lit("go.php?n=#N"), "list"), several(k % 5, F.lit("/document/#N.html"), "page"),
        several(k % 6, F.lit("https://bad.net/#N"), "out"), several(k % 7, F.lit("/files/0.pdf"), "again"), F.when(k % 8 < 4, '<a href="?page=2">2</a>').otherwise(""), F.when(k % 2 == 1, '<a href="/more/x">Next</a>').otherwise(""),
    ]
    pages = load(spark, sf_dir, "orders").select(k.alias("page_id"), F.lit("https://example.com/x/").alias("url"), F.concat(*parts).alias("html"))
    return counters(links(pages))


def with_columns(rows: DataFrame, declared: dict[str, tuple[str, object]]) -> DataFrame:
    """rows with the declared columns (name: (type, default)) that they lack; columns that are there stay as they are."""
    have = {c.lower() for c in rows.columns}
    return rows.withColumns({name: F.lit(default).cast(kind) for name, (kind, default) in declared.items() if name.lower() not in have})


#: Columns that later versions of a table add.
ADDED = {"lang": ("string", "none"), "priority": ("string", "Normal"), "ssl_fallback": ("boolean", False), "reviewed_at": ("timestamp", None)}


@C.query("SELECT doc_id, lang, 'Normal' AS priority, false AS ssl_fallback, CAST(NULL AS TIMESTAMP) AS reviewed_at FROM documents")
def added_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An old table read under a newer declaration; doing so twice changes nothing."""
    once = with_columns(load(spark, sf_dir, "documents").select("doc_id", "lang"), ADDED)
    return with_columns(once, ADDED)


# citizens


@C.query(
    """WITH s AS (SELECT event_id AS search, user_id AS citizen, 'q' || event_id % 10 AS q, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'D' || event_id % 5 END AS district FROM events WHERE event_type = 'signup'),
l AS (SELECT citizen, max(search) AS search FROM s GROUP BY citizen), d AS (SELECT l.search FROM events e JOIN l ON l.citizen = e.user_id AND e.event_id % 2 = 0 WHERE e.event_type = 'error')
SELECT search, citizen, q, district, CAST(row_number() OVER (PARTITION BY citizen ORDER BY search DESC) AS BIGINT) AS place FROM s WHERE search NOT IN (FROM d)"""
)
def saved_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches that citizens saved as JSON and did not delete, newest first; deleting another's changes nothing."""
    events, k = load(spark, sf_dir, "events"), F.col("event_id")
    kept = F.to_json(F.struct(F.concat(F.lit("q"), (k % 10).cast("string")).alias("q"), F.when(k % 3 != 0, F.concat(F.lit("D"), (k % 5).cast("string"))).alias("district")))
    saved = events.where("event_type = 'signup'").select(k.alias("search"), F.col("user_id").alias("citizen"), kept.alias("filter"))
    newest = saved.groupBy("citizen").agg(F.max("search").alias("search"))
    asked = events.where("event_type = 'error'").select(F.col("user_id").alias("of"), F.when(k % 2 == 0, F.col("user_id")).otherwise(F.col("user_id") + 1).alias("by"))
    deletes = asked.join(newest, asked["of"] == newest["citizen"]).select("search", F.col("by").alias("citizen")).distinct()
    left = saved.join(deletes, ["search", "citizen"], "left_anti").withColumn("f", F.from_json("filter", "q string, district string"))
    place = F.row_number().over(Window.partitionBy("citizen").orderBy(F.desc("search"))).cast("bigint")
    return left.select("search", "citizen", "f.q", "f.district", place.alias("place"))


@C.query("SELECT user_id AS source, event_id AS run, event_type AS result, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS BIGINT) AS place FROM events WHERE event_type IN ('purchase', 'error', 'signup') QUALIFY place <= 20")
def certification_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest twenty results of each source."""
    rows = load(spark, sf_dir, "events").where(F.col("event_type").isin("purchase", "error", "signup"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("event_id"))).cast("bigint")
    return rows.select(F.col("user_id").alias("source"), F.col("event_id").alias("run"), F.col("event_type").alias("result"), place.alias("place")).where("place <= 20")


# what is written once


def store_once(offered: DataFrame, folder: str) -> DataFrame:
    """Write the contents of offered(sha256, content) that folder(sha256, content) lacks, read them back, and report what was offered, written, there before, and not what its name says.

    What is there is read back and its bytes hashed again, so a damaged or foreign content under a name is found when that name is offered. Rows of a folder that is
    written anew by a failed task cannot come twice, as a write counts only when it is whole.
    """
    spark = offered.sparkSession
    n_offered, names = offered.count(), offered.select("sha256").distinct()
    have = spark.read.schema("sha256 string, content binary").parquet(folder)
    n_held = have.join(names, "sha256", "left_semi").count()
    new = offered.join(have.select("sha256"), "sha256", "left_anti").groupBy("sha256").agg(F.first("content").alias("content"))
    new.write.mode("append").parquet(folder)
    back = spark.read.schema("sha256 string, content binary").parquet(folder).join(names, "sha256", "left_semi")
    n_back, n_mismatch = back.agg(F.count(F.lit(1)), F.count_if(F.sha2("content", 256) != F.col("sha256"))).first()
    return spark.createDataFrame([(n_offered, n_back - n_held, n_held, n_mismatch)], "n_offered bigint, n_written bigint, n_held bigint, n_mismatch bigint")


@C.query(
    """WITH h AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha256 FROM documents), a AS (SELECT DISTINCT sha256 FROM h WHERE doc_id % 2 = 0), b AS (SELECT DISTINCT sha256 FROM h)
SELECT 1 AS pass, (SELECT count(*) FROM h WHERE doc_id % 2 = 0) AS n_offered, (SELECT count(*) FROM a) AS n_written, 0 AS n_held, 0 AS n_mismatch
UNION ALL SELECT 2, (SELECT count(*) FROM h), (SELECT count(*) FROM b) - (SELECT count(*) FROM a), (SELECT count(*) FROM a), 0 UNION ALL SELECT 3, (SELECT count(*) FROM h), 0, (SELECT count(*) FROM b), 0"""
)
def write_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stored by content in three passes: half of them, all, and all again."""
    docs, folder = load(spark, sf_dir, "documents"), shared_folder(spark) + "/store"
    content = F.coalesce("text", F.lit("")).cast("binary")
    offered = docs.select("doc_id", content.alias("content"), F.sha2(content, 256).alias("sha256"))
    spark.createDataFrame([], "sha256 string, content binary").write.parquet(folder)
    parts = [part.select("sha256", "content") for part in (offered.where("doc_id % 2 = 0"), offered, offered)]
    return _union([store_once(rows, folder).select(F.lit(i).alias("pass"), "*") for i, rows in enumerate(parts, 1)])


def persist(rows: DataFrame, folder: str, version: str) -> None:
    """Extraction results of one version, in place of those that the version left before; other versions stay."""
    rows.withColumn("version", F.lit(version)).write.partitionBy("version").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


@C.query(f"WITH {FACTS} SELECT version, count(*) AS n, count(DISTINCT doc_id) AS n_documents, CAST(sum(CASE WHEN won THEN 1 ELSE 0 END) AS BIGINT) AS n_won FROM (SELECT doc_id, 'v1' AS version, true AS won FROM facts UNION ALL SELECT doc_id, 'v2', true FROM facts UNION ALL SELECT doc_id, 'v2', false FROM facts WHERE form <> 3) GROUP BY version")
def persisted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Winners of a first version, then winners and losers of a second that is run twice."""
    ranked = extraction.ranked(extraction.candidates(order_pages(order_facts(spark, sf_dir)), ("go_number",)))
    kept = ranked.select("doc_id", "field", "normalized", (F.col("place") == 1).alias("won"))
    folder = shared_folder(spark) + "/candidates"
    persist(kept.where("won"), folder, "v1")
    for _ in range(2):
        persist(kept, folder, "v2")
    rows = spark.read.parquet(folder).groupBy("version")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_documents"), F.sum(F.col("won").cast("bigint")).alias("n_won"))


@C.query(
    f"""WITH {FACTS} SELECT doc_id, ['go_number', 'go_date', 'budget', 'district', 'subject', 'department'][doc_id % 6 + 1] AS field, doc_id % 4 <> 0 AS matched FROM facts"""
)
def field_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field of each order as annotated and as written otherwise; every fourth is another value."""
    k, n = F.col("doc_id"), F.col("number").cast("string")
    other = k % 4 == 0
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])
    plain = lambda c: c.cast("bigint").cast("string")
    after = F.when(F.col("district") == "Chennai", "Theni").otherwise("Chennai")
    pairs = {  # field: (expected, the same otherwise, another)
        "go_number": (text("G.O.(Ms) No.", n), text("G.O. Ms No. ", n), text("G.O.(Rt) No.", n)),
        "go_date": (F.date_format("dated", "dd.MM.yyyy"), F.col("dated").cast("string"), F.date_add("dated", 1).cast("string")),
        "budget": (text("Rs.", plain(F.col("amount")), " lakh"), plain(F.col("amount") * 100000), plain(F.col("amount") * 100000 + 2)),
        "district": (text(F.upper("district"), " "), F.col("district"), after),
        "subject": (text("Works of ", F.col("district"), " - ", n), text("Finance - Works of ", F.col("district"), " - ", n, " - Orders"), text("Roads of ", F.col("district"), " - ", n)),
        "department": (F.upper("department"), text(F.col("department"), "."), text(F.col("department"), " Works")),
    }
    rows = order_facts(spark, sf_dir).withColumn("field", picked(tuple(pairs), k))
    chosen = lambda i: reduce(lambda c, fp: c.when(F.col("field") == fp[0], fp[1][i]), pairs.items(), F.when(F.lit(False), ""))
    rows = rows.select(k, "field", chosen(0).alias("expected"), F.when(other, chosen(2)).otherwise(chosen(1)).alias("actual"))
    return rows.select(k, "field", T.values_match(F.col("field"), F.col("expected"), F.col("actual")).alias("matched"))


_LOGS = ("crawl", "download", "extraction", "sync", "certification")


@C.query(
    f"""WITH now AS (SELECT max(ts) AS now FROM events), l AS (SELECT unnest({list(_LOGS)}) AS log), f AS (SELECT {list(_LOGS)}[event_id % 5 + 1] AS log, ts FROM events WHERE event_type = 'error')
SELECT l.log, count(*) FILTER (ts >= date_trunc('day', now)) AS today, count(*) FILTER (ts >= now - INTERVAL 7 DAY) AS week, count(*) FILTER (ts >= now - INTERVAL 30 DAY) AS month FROM l CROSS JOIN now LEFT JOIN f ON f.log = l.log GROUP BY l.log"""
)
def failure_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures of five logs today, in 7 and in 30 days; a log without any has a row too."""
    events = load(spark, sf_dir, "events")
    failed = events.where("event_type = 'error'").select(picked(_LOGS, F.col("event_id")).alias("log"), "ts")
    every = spark.createDataFrame([(x,) for x in _LOGS], "log string")
    since = lambda n: F.count_if(F.col("ts") >= F.col("now") - F.expr(f"INTERVAL {n} DAY"))
    return with_now(every.join(failed, "log", "left"), events).groupBy("log").agg(F.count_if(F.to_date("ts") >= F.to_date("now")).alias("today"), since(7).alias("week"), since(30).alias("month"))


QUERIES, ORACLE_SQL = C.queries, C.oracle_sql
