"""Reports over whole runs: what each source's crawl saw, what became of every item at every stage, and extraction against its targets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions import text as T
from ..functions import vocabulary as V
from ..operators import extraction
from ..operators.crawling import _WALK, _site, crawl_runs_of, crawl_sources
from ..operators.extraction import FACTS
from ..sources.tables import load, order_facts, order_pages

C = Catalog()

# a source's diagnostic report


def report_text(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """(source, report): the report of runs(source, name, status, counters) with its requests(source, turn, url, status, error) in order."""
    answer = F.concat_ws("\n", F.concat(F.lit("Target URL: "), F.col("url").cast("string")), F.concat(F.lit("  HTTP Status: "), F.coalesce(F.col("status").cast("string"), F.lit("0"))), F.concat(F.lit("  Technical Evidence: "), F.col("error")))
    seen = requests.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", answer.alias("shown")))), lambda x: x["shown"]), "\n").alias("evidence"))
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value.cast("string"))
    head = [
        line("DIAGNOSTIC REPORT FOR SOURCE", F.col("name")), line("Run Status", F.col("status")), line("Pages Visited", F.col("pages_fetched")), line("Links Found", F.col("links_seen")), line("New Documents", F.col("new_documents")),
        line("Already Known", F.col("duplicate_documents")), line("Failed Pages", F.col("page_errors")), line("Last Error", F.coalesce("error", F.lit("None"))), F.lit("=== Visited URL Evidences ==="),
    ]
    return runs.join(seen, "source", "left").select("source", F.concat_ws("\n", *head, "evidence").alias("report"))


_RUNS = f"""{_WALK}, r AS (SELECT * FROM walk WHERE turn > 0), d AS (SELECT r.source, l.l_orderkey AS document, count(DISTINCT r.turn) AS times, min(r.turn) AS turn FROM r JOIN lineitem l ON l.l_partkey = r.url WHERE r.status = 200 GROUP BY 1, 2)"""


@C.query(
    f"""WITH {_RUNS}, n AS (SELECT source, CAST(sum(times) AS BIGINT) AS links_seen, count(*) AS new_documents FROM d GROUP BY source),
c AS (SELECT r.source, max(error) AS error, count(*) FILTER (error IS NULL) AS fetched, count(*) FILTER (status <> 200 AND error IS NULL) AS page_errors,
string_agg('Target URL: ' || url || chr(10) || '  HTTP Status: ' || coalesce(status, 0) || coalesce(chr(10) || '  Technical Evidence: ' || error, ''), chr(10) ORDER BY turn) AS evidence FROM r GROUP BY r.source)
SELECT c.source, 'DIAGNOSTIC REPORT FOR SOURCE: ' || s_name || chr(10) || 'Run Status: ' || CASE WHEN error IS NULL THEN 'ok' ELSE 'error' END || chr(10) || 'Pages Visited: ' || fetched || chr(10) || 'Links Found: ' || coalesce(links_seen, 0) || chr(10)
|| 'New Documents: ' || coalesce(new_documents, 0) || chr(10) || 'Already Known: ' || coalesce(links_seen - new_documents, 0) || chr(10) || 'Failed Pages: ' || page_errors || chr(10) || 'Last Error: ' || coalesce(error, 'None') || chr(10) || '=== Visited URL Evidences ===' || chr(10) || evidence AS report
FROM c LEFT JOIN n USING (source) JOIN supplier ON s_suppkey = c.source"""
)
def diagnostic_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of each source's crawl, with a block for each request."""
    sources, pages, follow, documents = _site(spark, sf_dir)
    requests = crawl_sources(sources, pages, follow)
    names = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_name").alias("name"))
    return report_text(crawl_runs_of(sources, requests, documents).join(names, "source"), requests)


# stages


def staged(items: DataFrame, **errors: Column) -> DataFrame:
    """items with the stage at which each failed and why, null for those that pass all; a stage is an error's text or null, and takes only what the stages before it let through."""
    stages = reduce(lambda c, s: c.when(s[1].isNotNull(), F.struct(F.lit(s[0]).alias("stage"), s[1].alias("error"))), errors.items(), F.when(F.lit(False), F.lit(None)))
    return items.withColumn("_failed", stages).select(*items.columns, F.col("_failed.stage").alias("failed_at"), F.col("_failed.error").alias("error"))


def stage_counts(done: DataFrame, key: str, stages: tuple[str, ...], shown: int = 3) -> DataFrame:
    """(key, stage, processed, succeeded, failed, errors): each stage of each key's run; errors are the first few kinds of failure, by name."""
    order = F.array(*[F.lit(s) for s in stages])
    reached = F.coalesce(F.array_position(order, F.col("failed_at")), F.lit(len(stages))).cast("int")
    rows = done.select(key, F.posexplode(F.slice(order, F.lit(1), reached)).alias("place", "stage"), "failed_at", "error")
    failed = F.col("failed_at").eqNullSafe(F.col("stage"))
    kinds = F.array_sort(F.collect_set(F.when(failed, F.col("error"))))
    counted = rows.groupBy(key, "stage").agg(F.count(F.lit(1)).alias("processed"), F.count_if(~failed).alias("succeeded"), F.count_if(failed).alias("failed"), F.array_join(F.slice(kinds, 1, shown), "; ").alias("errors"))
    return counted


_STAGES = ("download", "store", "parse")
_ITEMS = f"""{_RUNS}, i AS (SELECT d.source, d.document, CASE WHEN o_orderstatus = 'P' THEN 'download' WHEN first < d.document THEN 'store' WHEN o_totalprice < 20000 THEN 'parse' END AS failed_at,
CASE WHEN o_orderstatus = 'P' THEN 'status 404' WHEN first < d.document THEN 'held already' WHEN o_totalprice < 20000 THEN 'no text on ' || o_orderpriority END AS error
FROM d JOIN (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderdate) AS first FROM orders) o ON o.o_orderkey = d.document)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that each source's crawl found, and the stage that each failed at: orders that are pending cannot be had, a customer's later order of a day is held already, a small one has no text."""
    sources, pages, follow, documents = _site(spark, sf_dir)
    found = crawl_sources(sources, pages, follow).where("error IS NULL AND status = 200").join(documents, "url").select("source", "document").distinct()
    orders = load(spark, sf_dir, "orders")
    least = orders.groupBy("o_custkey", "o_orderdate").agg(F.min("o_orderkey").alias("first"))
    rows = found.join(orders, found.document == orders.o_orderkey).join(least, ["o_custkey", "o_orderdate"])
    done = staged(
        rows, download=F.when(F.col("o_orderstatus") == "P", "status 404"), store=F.when(F.col("first") < F.col("document"), "held already"),
        parse=F.when(F.col("o_totalprice") < 20000, F.concat(F.lit("no text on "), F.col("o_orderpriority"))),
    )
    return done.select("source", "document", "failed_at", "error")


@C.query(f"WITH {_ITEMS} SELECT source, document, failed_at, error FROM i")
def stage_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of every item; one that fails stops no other."""
    return _items(spark, sf_dir)


@C.query(
    f"""WITH {_ITEMS}, s AS (SELECT unnest(['download', 'store', 'parse']) AS stage, unnest([1, 2, 3]) AS place), p AS (SELECT i.*, CASE failed_at WHEN 'download' THEN 1 WHEN 'store' THEN 2 ELSE 3 END AS reached FROM i)
SELECT source, stage, count(*) AS processed, count(*) FILTER (failed_at IS DISTINCT FROM stage) AS succeeded, count(*) FILTER (failed_at = stage) AS failed,
coalesce(list_aggregate(list_sort(list_distinct(list(error) FILTER (failed_at = stage)))[1:3], 'string_agg', '; '), '') AS errors FROM p JOIN s ON s.place <= p.reached GROUP BY source, stage"""
)
def stage_report_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage_counts(_items(spark, sf_dir), "source", _STAGES)


# extraction against its targets


def against_targets(found: DataFrame, expected: DataFrame) -> DataFrame:
    """(field, n, n_correct, n_missed, accuracy, target, passed) of found(doc_id, field, value) against expected(doc_id, field, wanted), each field compared as it is meant."""
    met = expected.join(found, ["doc_id", "field"], "left").withColumn("ok", F.coalesce(T.values_match(F.col("field"), F.col("wanted"), F.col("value")), F.lit(False)))
    out = met.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.count_if("ok").alias("n_correct"), F.count_if(F.col("value").isNull()).alias("n_missed"))
    out = out.withColumn("accuracy", F.round(F.col("n_correct") / F.col("n"), 6)).withColumn("target", T.looked_up(F.col("field"), V.ACCURACY_TARGETS))
    return out.withColumn("passed", F.col("accuracy") >= F.col("target"))


@C.query(
    f"""WITH {FACTS}, t(field, target) AS (VALUES {", ".join(f"('{f}', {t}::DOUBLE)" for f, t in V.ACCURACY_TARGETS.items())}) SELECT field, (SELECT count(*) FROM facts) AS n, (SELECT count(*) FROM facts) AS n_correct, 0::BIGINT AS n_missed, 1.0::DOUBLE AS accuracy, target, true AS passed FROM t"""
)
def extraction_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields extracted from the generated orders, against the facts they were made of and the targets of certification."""
    facts = order_facts(spark, sf_dir)
    n = F.col("number").cast("string")
    series = F.when(F.col("form") == 0, "G.O.(Ms) No.").when(F.col("form") == 1, "G.O. No.").when(F.col("form") == 2, "G.O.(Rt) No.").when(F.col("form") == 3, "Order No.").otherwise("G.O.(D) No.")
    wanted = {
        "go_number": F.concat(series, n), "go_date": F.date_format("dated", "dd.MM.yyyy"), "department": F.col("department"), "subject": F.concat("department", F.lit(" Department - Works of the year")),
        "budget": F.concat(F.lit("Rs."), F.col("amount").cast("string"), F.lit(" lakh")), "district": F.upper("district"), "scheme_name": F.concat("scheme", F.lit(" Scheme")),
    }
    expected = facts.select("doc_id", F.explode(F.map_from_arrays(F.array(*[F.lit(f) for f in wanted]), F.array(*wanted.values()))).alias("field", "wanted"))
    found = extraction.winners(extraction.candidates(order_pages(facts))).select("doc_id", "field", F.col("normalized").alias("value"))
    return against_targets(found, expected)


QUERIES, ORACLE_SQL = C.queries, C.oracle_sql
