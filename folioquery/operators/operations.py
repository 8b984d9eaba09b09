"""Operations: sources and their health, geography, publication, diagnostics, jobs, sessions. events stand for crawl and connectivity
logs (error = failure), suppliers for sources (every fifth covers a whole region), nations for districts, regions for states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import Catalog
from ..functions import vocabulary as V
from ..functions import web as W
from ..sources.tables import load, picked
from .records import zero_filled
from .web import BLOCKED, SUFFIXES

C = Catalog()
STAGES = ("DISCOVERED", "ACTIVE", "CERTIFIED", "PUBLISHED", "RETIRED")
CERTIFICATION = ("CERTIFIED", "PARTIALLY_CERTIFIED", "FAILED", "PENDING")


def as_of(events: DataFrame) -> DataFrame:
    """One row: the time of the newest entry, which stands for now."""
    return events.agg(F.max("ts").alias("now"))


def with_now(rows: DataFrame, events: DataFrame) -> DataFrame:
    return rows.crossJoin(F.broadcast(as_of(events)))  # one row


_NOW = "now AS (SELECT max(ts) AS now FROM events)"


@C.query(
    f"""WITH {_NOW}, s AS (SELECT user_id AS source_id, max(ts) AS last_at, CASE user_id % 5 WHEN 0 THEN 'hourly' WHEN 1 THEN 'daily' WHEN 2 THEN 'weekly' WHEN 3 THEN 'manual' ELSE 'odd' END AS frequency, user_id % 7 <> 0 AS active FROM events GROUP BY user_id)
SELECT source_id, frequency, active, active AND frequency <> 'manual' AND CASE frequency WHEN 'hourly' THEN now - last_at >= INTERVAL 1 HOUR WHEN 'daily' THEN now - last_at >= INTERVAL 24 HOUR WHEN 'weekly' THEN now - last_at >= INTERVAL 168 HOUR ELSE true END AS due FROM s, now"""
)
def crawl_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose interval has passed; one never crawled, or of an unknown frequency, is due."""
    events = load(spark, sf_dir, "events")
    frequency = F.get(F.array(*[F.lit(x) for x in ("hourly", "daily", "weekly", "manual", "odd")]), (F.col("source_id") % 5).cast("int"))
    rows = events.groupBy(F.col("user_id").alias("source_id")).agg(F.max("ts").alias("last_at")).withColumn("frequency", frequency).withColumn("active", F.col("source_id") % 7 != 0)
    hours = reduce(lambda c, x: c.when(F.col("frequency") == x[0], x[1]), (("hourly", 1), ("daily", 24), ("weekly", 168)), F.when(F.lit(False), 0))
    waited = F.timestamp_diff("SECOND", "last_at", "now")
    due = F.col("active") & (F.col("frequency") != "manual") & (F.col("last_at").isNull() | hours.isNull() | (waited >= hours * 3600))
    return with_now(rows, events).select("source_id", "frequency", "active", due.alias("due"))


@C.query(f"WITH {_NOW} SELECT event_id, user_id FROM events, now WHERE ts >= now - INTERVAL 10 DAY")
def retention_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    return with_now(events, events).where(F.col("ts") >= F.col("now") - F.expr("INTERVAL 10 DAY")).select("event_id", "user_id")


def entries_until(log: DataFrame, points: DataFrame) -> DataFrame:
    """(ts, n, errors, n_here, errors_here) for each ts of log(ts, n, errors) and points(ts): entries up to and at that time.

    Running sums by hour, and those of whole hours before it; rows that share a time are one before any window sees them.
    """
    instants = log.unionByName(points.select("ts", F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("errors"))).where("ts is not null")
    instants = instants.groupBy("ts").agg(F.sum("n").alias("n_here"), F.sum("errors").alias("errors_here")).withColumn("hour", F.date_trunc("hour", "ts"))
    sofar = Window.partitionBy("hour").orderBy("ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)  # a row for each hour, however many entries
    hours = instants.groupBy("hour").agg(F.sum("n_here").alias("n"), F.sum("errors_here").alias("errors"))
    base = hours.select("hour", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_base"), F.coalesce(F.sum("errors").over(earlier), F.lit(0)).alias("errors_base"))
    within = instants.select("*", F.sum("n_here").over(sofar).alias("n"), F.sum("errors_here").over(sofar).alias("errors")).join(base, "hour")
    return within.select("ts", (F.col("n") + F.col("n_base")).alias("n"), (F.col("errors") + F.col("errors_base")).alias("errors"), "n_here", "errors_here")


@C.query(
    f"""WITH {_NOW}, jobs AS (SELECT event_id AS job_id, ts AS started, CASE WHEN event_type = 'purchase' THEN NULL ELSE ts + INTERVAL 6 HOUR END AS finished FROM events)
SELECT job_id, count(e.event_id) AS n_runs, count(*) FILTER (e.event_type = 'error') AS n_errors FROM jobs, now LEFT JOIN events e ON e.ts BETWEEN started AND coalesce(finished, now) GROUP BY job_id"""
)
def job_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries within each job's time, an unfinished one's being up to now: the entries up to its end less those before its start.

    As only counts are asked for, no pair of a job and an entry is made; a job of any length costs the same.
    """
    events = load(spark, sf_dir, "events")
    jobs = events.select(F.col("event_id").alias("job_id"), F.col("ts").alias("started"), F.when(F.col("event_type") != "purchase", F.col("ts") + F.expr("INTERVAL 6 HOUR")).alias("finished"))
    log = events.groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    until = entries_until(log, jobs.select(F.col("finished").alias("ts")))
    first = until.select(F.col("ts").alias("started"), (F.col("n") - F.col("n_here")).alias("n_before"), (F.col("errors") - F.col("errors_here")).alias("errors_before"))
    last = until.select(F.col("ts").alias("finished"), F.col("n").alias("n_end"), F.col("errors").alias("errors_end"))
    total = log.where("ts is not null").agg(F.sum("n").alias("n_all"), F.sum("errors").alias("errors_all"))
    met = jobs.join(first, "started", "left").join(last, "finished", "left").crossJoin(F.broadcast(total))  # one row
    count = lambda x: F.coalesce(F.coalesce(f"{x}_end", f"{x}_all") - F.col(f"{x}_before"), F.lit(0))
    return met.select("job_id", count("n").alias("n_runs"), count("errors").alias("n_errors"))


@C.query(
    """WITH r AS (SELECT user_id, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events)
SELECT user_id AS source_id, count(*) AS n_history, round(avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS success_rate, CASE WHEN count(*) >= 3 THEN avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) >= 0.8 ELSE true END AS stable FROM r WHERE place <= 5 GROUP BY user_id"""
)
def source_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Success over the last five runs; fewer than three are no ground to judge."""
    by = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    rows = load(spark, sf_dir, "events").select("user_id", (F.col("event_type") != "error").cast("double").alias("ok"), F.row_number().over(by).alias("place")).where("place <= 5")
    rate, n = F.avg("ok"), F.count(F.lit(1))
    return rows.groupBy(F.col("user_id").alias("source_id")).agg(n.alias("n_history"), F.round(rate, 6).alias("success_rate"), F.when(n >= 3, rate >= 0.8).otherwise(True).alias("stable"))


_SUPPLY = """found AS (SELECT l_suppkey AS id, count(*) AS found, count(*) FILTER (l_returnflag = 'R') AS failed FROM lineitem GROUP BY l_suppkey),
loaded AS (SELECT ps AS id, count(*) AS downloaded FROM (SELECT l_suppkey AS ps FROM lineitem WHERE l_linestatus = 'F' AND l_returnflag = 'N' AND l_quantity > 49) GROUP BY ps),
sources AS (SELECT s_suppkey AS id, s_name AS name, s_suppkey % 9 <> 0 AS active, CASE WHEN s_suppkey % 10 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'error' ELSE 'ok' END AS last_status, s_suppkey % 10 = 0 AS never,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_nationkey END AS nation, n_regionkey AS region, ['CERTIFIED', 'PARTIALLY_CERTIFIED', 'FAILED', 'PENDING'][s_suppkey % 4 + 1] AS certification FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, name, active, last_status, never, nation, region, certification): nation is null for a source of a whole region."""
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("region"))
    k = F.col("s_suppkey")
    return load(spark, sf_dir, "supplier").join(n, "s_nationkey").select(
        k.alias("id"), F.col("s_name").alias("name"), (k % 9 != 0).alias("active"), F.when(k % 10 == 0, None).when(k % 3 == 0, "error").otherwise("ok").alias("last_status"), (k % 10 == 0).alias("never"),
        F.when(k % 5 != 0, F.col("s_nationkey")).alias("nation"), "region", picked(CERTIFICATION, k).alias("certification"),
    )


@C.query(
    f"""WITH {_SUPPLY}, h AS (SELECT id, name, never, coalesce(found, 0) AS found, coalesce(downloaded, 0) AS downloaded, coalesce(failed, 0) AS failed,
  CASE WHEN last_status IS NULL OR last_status = 'ok' THEN 50 ELSE 0 END + CASE WHEN coalesce(downloaded, 0) > 0 THEN 30 ELSE 0 END + CASE WHEN coalesce(failed / found, 0) < 0.2 THEN 20 ELSE 0 END AS score FROM sources LEFT JOIN found USING (id) LEFT JOIN loaded USING (id) WHERE active)
SELECT id, name, found, downloaded, failed, score, CASE WHEN never THEN 'Offline' WHEN score >= 80 THEN 'Healthy' WHEN score >= 50 THEN 'Warning' WHEN score >= 20 THEN 'Critical' ELSE 'Offline' END AS status FROM h"""
)
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score of 50 for the last crawl, 30 for any download, 20 for few rejections. Each log is summed before it is joined, so nothing fans out."""
    item = load(spark, sf_dir, "lineitem")
    found = item.groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    loaded = item.where("l_linestatus = 'F' AND l_returnflag = 'N' AND l_quantity > 49").groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("downloaded"))
    rows = sources(spark, sf_dir).where("active").join(found, "id", "left").join(loaded, "id", "left").fillna(0, ["found", "failed", "downloaded"])
    rejected = F.coalesce(F.try_divide("failed", "found"), F.lit(0.0))
    part = lambda c, n: F.when(c, n).otherwise(0)
    score = part(F.col("last_status").isNull() | (F.col("last_status") == "ok"), 50) + part(F.col("downloaded") > 0, 30) + part(rejected < 0.2, 20)
    status = F.when(F.col("never"), "Offline").when(F.col("score") >= 80, "Healthy").when(F.col("score") >= 50, "Warning").when(F.col("score") >= 20, "Critical").otherwise("Offline")
    return rows.withColumn("score", score).select("id", "name", "found", "downloaded", "failed", "score", status.alias("status"))


@C.query(
    """WITH s AS (SELECT user_id AS source_id, max_by(event_type, event_id) AS last_type, max(CASE WHEN event_type <> 'error' AND event_id % 3 = 0 THEN ts END) AS success_at, max(CASE WHEN event_type = 'error' THEN ts END) AS failure_at FROM events GROUP BY user_id)
SELECT source_id, last_type = 'error' OR (failure_at IS NOT NULL AND (success_at IS NULL OR success_at < failure_at)) AS down FROM s"""
)
def source_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Down if the last entry failed, or the last failure is later than the last success; no success is earlier than any."""
    e = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source_id")).agg(
        F.max_by("event_type", "event_id").alias("last_type"),
        F.max(F.when((F.col("event_type") != "error") & (F.col("event_id") % 3 == 0), F.col("ts"))).alias("success_at"),
        F.max(F.when(F.col("event_type") == "error", F.col("ts"))).alias("failure_at"),
    )
    late = F.col("failure_at").isNotNull() & (F.col("success_at").isNull() | (F.col("success_at") < F.col("failure_at")))
    return e.select("source_id", ((F.col("last_type") == "error") | late).alias("down"))


@C.query(
    f"WITH {_NOW} SELECT user_id AS agent_id, user_id % 10 <> 0 AND date_diff('second', max(ts), max(now)) <= 86400 AS online FROM events, now GROUP BY user_id"
)
def agent_online(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seen within the last day and not revoked."""
    events = load(spark, sf_dir, "events")
    last = events.groupBy(F.col("user_id").alias("agent_id")).agg(F.max("ts").alias("seen"))
    return with_now(last, events).select("agent_id", ((F.col("agent_id") % 10 != 0) & (F.timestamp_diff("SECOND", "seen", "now") <= 86400)).alias("online"))


_SCOPE = f"""{_SUPPLY}, scope AS (SELECT n_nationkey AS district, id, certification FROM sources JOIN nation ON n_nationkey = nation UNION ALL SELECT n_nationkey, id, certification FROM sources JOIN nation ON nation IS NULL AND n_regionkey = region)"""


def scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(district, id, certification): a district's own sources and those of its whole state, as two equi-joins."""
    rows, n = sources(spark, sf_dir), load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("district"), F.col("n_regionkey").alias("state"))
    own = rows.where("nation is not null").join(n, F.col("nation") == F.col("district"))
    wide = rows.where("nation is null").join(n, F.col("region") == F.col("state"))
    return own.select("district", "id", "certification").unionByName(wide.select("district", "id", "certification"))


@C.query(f"WITH {_SCOPE} SELECT district, id FROM scope")
def scope_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope(spark, sf_dir).select("district", "id")


@C.query(f"WITH {_SCOPE} SELECT id, count(*) AS n_districts FROM scope GROUP BY id")
def districts_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope(spark, sf_dir).groupBy("id").agg(F.count(F.lit(1)).alias("n_districts"))


_ROLLUP = f"""{_SCOPE}, rollup AS (SELECT n_nationkey AS district, CASE WHEN count(id) = 0 THEN 'PENDING' WHEN bool_and(certification = 'CERTIFIED') THEN 'CERTIFIED' WHEN bool_or(certification IN ('CERTIFIED', 'PARTIALLY_CERTIFIED')) THEN 'PARTIALLY_CERTIFIED' WHEN bool_and(certification = 'FAILED') THEN 'FAILED' ELSE 'PENDING' END AS status
FROM nation LEFT JOIN scope s ON s.district = n_nationkey GROUP BY n_nationkey)"""


def rolled_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A district's status from the set of its sources' statuses."""
    n = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("district"))
    rows = n.join(scope(spark, sf_dir), "district", "left").groupBy("district").agg(F.collect_set("certification").alias("have"))
    only = lambda s: (F.size("have") == 1) & F.array_contains("have", s)
    status = (
        F.when(F.size("have") == 0, "PENDING").when(only("CERTIFIED"), "CERTIFIED")
        .when(F.array_contains("have", "CERTIFIED") | F.array_contains("have", "PARTIALLY_CERTIFIED"), "PARTIALLY_CERTIFIED").when(only("FAILED"), "FAILED").otherwise("PENDING")
    )
    return rows.select("district", status.alias("status"))


@C.query(f"WITH {_ROLLUP} SELECT district, status FROM rollup")
def district_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolled_up(spark, sf_dir)


@C.query(
    f"""WITH {_ROLLUP}, approved AS (SELECT c_nationkey AS district, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' GROUP BY c_nationkey)
SELECT r.district, CASE WHEN r.status NOT IN ('CERTIFIED', 'PARTIALLY_CERTIFIED') THEN 'not certified: ' || r.status WHEN coalesce(a.n, 0) = 0 THEN 'no approved records' ELSE 'publish' END AS verdict FROM rollup r LEFT JOIN approved a USING (district)"""
)
def publication_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a district may be published, or the first reason why not."""
    o, c = load(spark, sf_dir, "orders").where("o_orderstatus = 'F'"), load(spark, sf_dir, "customer")
    approved = o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_nationkey").alias("district")).agg(F.count(F.lit(1)).alias("n"))
    rows = rolled_up(spark, sf_dir).join(approved, "district", "left")
    verdict = F.when(~F.col("status").isin("CERTIFIED", "PARTIALLY_CERTIFIED"), F.concat(F.lit("not certified: "), "status")).when(F.coalesce("n", F.lit(0)) == 0, "no approved records").otherwise("publish")
    return rows.select("district", verdict.alias("verdict"))


@C.query(f"WITH {_ROLLUP} SELECT count(*) AS n_districts, count(*) FILTER (status = 'CERTIFIED') AS n_certified, count(*) FILTER (status = 'PARTIALLY_CERTIFIED') AS n_partial, round(100.0::DOUBLE * count(*) FILTER (status IN ('CERTIFIED', 'PARTIALLY_CERTIFIED')) / count(*), 2) AS percent FROM rollup")
def publication_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, n = rolled_up(spark, sf_dir), F.count(F.lit(1))
    some = F.count_if(F.col("status").isin("CERTIFIED", "PARTIALLY_CERTIFIED"))
    return rows.agg(n.alias("n_districts"), F.count_if(F.col("status") == "CERTIFIED").alias("n_certified"), F.count_if(F.col("status") == "PARTIALLY_CERTIFIED").alias("n_partial"), F.round(100.0 * some / n, 2).alias("percent"))


@C.query(f"WITH {_SUPPLY} SELECT c.status, count(s.id) AS n FROM (VALUES ('CERTIFIED'), ('PARTIALLY_CERTIFIED'), ('FAILED'), ('PENDING')) c(status) LEFT JOIN sources s ON s.certification = c.status GROUP BY c.status")
def certification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = sources(spark, sf_dir).groupBy(F.col("certification").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    return zero_filled(counts, "status", CERTIFICATION)


def certified(sources: DataFrame, runs: DataFrame) -> DataFrame:
    """(source, result) of sources(source, address, host) and runs(source, run, code, size, links, files, ok).

    The newest run tells whether a source answers, leads to documents and lets them be loaded; its host must be approved and be the one registered.
    It is steady if the newest two runs differ in size by half at most and, of three runs or more, four fifths of the last five went well.
    Without an answer, a good host or links it fails; with all five it is certified, else in part.
    """
    by = Window.partitionBy("source").orderBy(F.desc("run"))
    last = runs.withColumn("place", F.row_number().over(by)).where("place <= 5")
    at = lambda n, c: F.max(F.when(F.col("place") == n, F.col(c)))
    seen = last.groupBy("source").agg(
        at(1, "code").alias("code"), at(1, "links").alias("links"), at(1, "files").alias("files"), at(1, "size").alias("a"), at(2, "size").alias("b"), F.count(F.lit(1)).alias("n"), F.avg(F.col("ok").cast("double")).alias("rate")
    )
    rows = sources.join(seen, "source", "left")
    authentic = W.approved(F.col("address"), SUFFIXES, BLOCKED) & W.host(F.col("address")).eqNullSafe(F.col("host"))
    must = (F.coalesce("code", F.lit(0)) == 200) & authentic & (F.coalesce("links", F.lit(0)) > 0)
    size, before = F.coalesce("a", F.lit(0)), F.coalesce("b", "a", F.lit(0))
    steady = (F.abs(size - before) / F.greatest(size, before, F.lit(1)) <= 0.5) & F.coalesce((F.col("n") < 3) | (F.col("rate") >= 0.8), F.lit(True))
    return rows.select("source", F.when(~must, "FAILED").when((F.coalesce("files", F.lit(0)) > 0) & steady, "CERTIFIED").otherwise("PARTIALLY_CERTIFIED").alias("result"))


_RUNS = """runs AS (SELECT o_custkey AS source, o_orderkey AS run, CASE WHEN o_orderstatus = 'P' THEN 503 ELSE 200 END AS code, CAST(floor(o_totalprice) AS BIGINT) AS size, coalesce(n, 0) AS links, coalesce(files, 0) AS files, o_orderpriority <> '5-LOW' AS ok
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS files FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey)"""


@C.query(
    f"""WITH {_RUNS}, s AS (SELECT c_custkey AS source, CASE c_nationkey % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN c_custkey % 10 <> 0 ELSE c_custkey % 2 = 0 END AS authentic FROM customer),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY run DESC) AS place FROM runs),
h AS (SELECT source, avg(CASE WHEN ok THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS rate, count(*) AS n FROM p WHERE place <= 5 GROUP BY source)
SELECT s.source, CASE WHEN NOT authentic OR coalesce(a.code, 0) <> 200 OR coalesce(a.links, 0) = 0 THEN 'FAILED' WHEN a.files > 0 AND abs(a.size - coalesce(b.size, a.size)) / greatest(a.size, coalesce(b.size, a.size), 1) <= 0.5 AND (h.n < 3 OR h.rate >= 0.8) THEN 'CERTIFIED' ELSE 'PARTIALLY_CERTIFIED' END AS result
FROM s LEFT JOIN p a ON a.source = s.source AND a.place = 1 LEFT JOIN p b ON b.source = s.source AND b.place = 2 LEFT JOIN h ON h.source = s.source"""
)
def source_certification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources and their orders as runs: items are links, shipped ones files; some addresses are blocked, unknown, or not the registered ones."""
    item = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("run")).agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("l_linestatus") == "F").alias("files"))
    code = F.when(F.col("o_orderstatus") == "P", 503).otherwise(200)
    runs = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("source"), code.alias("code"), F.floor("o_totalprice").alias("size"), (F.col("o_orderpriority") != "5-LOW").alias("ok")).join(item, "run", "left")
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    address = F.when(n % 4 == 0, "HTTPS://a.Example.com/x").when(n % 4 == 1, "https://news.example.com/").when(n % 4 == 2, "http://example.org").when(k % 2 == 0, "http://me@b.example.org:80/").otherwise("https://example.org.bad.net/")
    host = F.when(n % 4 == 0, "a.example.com").when(n % 4 == 1, "news.example.com").when(n % 4 == 2, F.when(k % 10 == 0, "old.example.org").otherwise("example.org")).when(k % 2 == 0, "b.example.org").otherwise("example.org.bad.net")
    return certified(load(spark, sf_dir, "customer").select(k.alias("source"), address.alias("address"), host.alias("host")), runs)


@C.query(
    f"""WITH {_NOW} SELECT count(*) FILTER (event_type = 'error' AND ts >= date_trunc('day', now)) AS today, count(*) FILTER (event_type = 'error' AND ts >= now - INTERVAL 7 DAY) AS week, count(*) FILTER (event_type = 'error' AND ts >= now - INTERVAL 30 DAY) AS month, count(*) AS total FROM events, now"""
)
def failure_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures today, in 7 and in 30 days, in one pass over the log."""
    events = load(spark, sf_dir, "events")
    error = F.col("event_type") == "error"
    since = lambda n: F.count_if(error & (F.col("ts") >= F.col("now") - F.expr(f"INTERVAL {n} DAY")))
    today = F.count_if(error & (F.to_date("ts") >= F.to_date("now")))
    return with_now(events, events).agg(today.alias("today"), since(7).alias("week"), since(30).alias("month"), F.count(F.lit(1)).alias("total"))


@C.query("SELECT coalesce(CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_type END, 'unknown') AS cause, count(*) AS n, round(avg(value), 6) AS mean_ms, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS n_slow FROM events GROUP BY CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_type END")
def root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("event_id") % 6 != 0, F.col("event_type"))
    rows = load(spark, sf_dir, "events").groupBy(raw.alias("raw")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_ms"), F.sum((F.col("value") > 50).cast("bigint")).alias("n_slow"))
    return rows.select(F.coalesce("raw", F.lit("unknown")).alias("cause"), "n", "mean_ms", "n_slow")


@C.query("SELECT coalesce((SELECT event_type FROM events WHERE event_type <> 'click' GROUP BY event_type ORDER BY count(*) DESC, event_type LIMIT 1), 'None') AS most_common, (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'error') AS n_targets_failed, (SELECT count(*) FROM events) AS n_tests")
def network_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    top = events.where("event_type <> 'click'").groupBy("event_type").count().orderBy(F.desc("count"), "event_type").limit(1).agg(F.coalesce(F.first("event_type"), F.lit("None")).alias("most_common"))
    rest = events.agg(F.countDistinct(F.when(F.col("event_type") == "error", F.col("user_id"))).alias("n_targets_failed"), F.count(F.lit(1)).alias("n_tests"))
    return top.crossJoin(rest)  # one row each


@C.query("SELECT user_id AS target, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def latest_per_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("target"))
    return rows.agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"), F.max_by("value", "event_id").alias("value"))


_PROBE = """probes AS (SELECT event_id, event_id // 20 AS batch, user_id, user_id < 30 AS control, event_type = 'error' OR value > 80 AS failed, ['DNS_RESOLUTION_FAILED', 'HTTP_404', 'READ_TIMEOUT', 'CONNECT_TIMEOUT', 'POLICY_BLOCKED'][event_id % 5 + 1] AS cause FROM events)"""


@C.query(
    f"""WITH {_PROBE}, c AS (SELECT batch, bool_or(failed AND cause IN ({", ".join(repr(c) for c in V.EGRESS_CAUSES)})) AS egress FROM probes WHERE control GROUP BY batch)
SELECT p.event_id, CASE WHEN c.batch IS NULL THEN 'No control targets available for comparison' WHEN c.egress THEN 'Global network issue detected' WHEN NOT p.failed OR p.cause IN ('HTTP_404') THEN 'Render outbound connectivity healthy' ELSE 'Target-specific failure detected' END AS conclusion FROM probes p LEFT JOIN c USING (batch) WHERE NOT p.control"""
)
def comparison_conclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the control targets of a batch say of a target's failure. An HTTP status with a cause of its own names no failed stage, so it counts as healthy."""
    k = F.col("event_id")
    causes = ("DNS_RESOLUTION_FAILED", "HTTP_404", "READ_TIMEOUT", "CONNECT_TIMEOUT", "POLICY_BLOCKED")
    probes = load(spark, sf_dir, "events").select(
        k, F.floor(k / 20).alias("batch"), (F.col("user_id") < 30).alias("control"), ((F.col("event_type") == "error") | (F.col("value") > 80)).alias("failed"), picked(causes, k).alias("cause")
    )
    egress = probes.where("control").groupBy("batch").agg(F.bool_or(F.col("failed") & F.col("cause").isin(*V.EGRESS_CAUSES)).alias("egress"))
    ok = ~F.col("failed") | F.col("cause").isin("HTTP_404")
    conclusion = (
        F.when(F.col("egress").isNull(), "No control targets available for comparison").when(F.col("egress"), "Global network issue detected")
        .when(ok, "Render outbound connectivity healthy").otherwise("Target-specific failure detected")
    )
    return probes.where("not control").join(egress, "batch", "left").select("event_id", conclusion.alias("conclusion"))


@C.query("SELECT event_id, 390 + event_id % 130 AS code, CASE WHEN 390 + event_id % 130 = 403 THEN 'HTTP_403_BLOCKED' WHEN 390 + event_id % 130 = 404 THEN 'HTTP_404' WHEN 390 + event_id % 130 BETWEEN 500 AND 599 THEN 'HTTP_500' END AS cause FROM events")
def status_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("event_id") % 130 + 390
    return load(spark, sf_dir, "events").select("event_id", code.alias("code"), W.status_cause(code).alias("cause"))


def classified(failures: DataFrame) -> DataFrame:
    """failures(phase, exception, code, ...) with root_cause, confidence and failure_stage.

    A status code decides where there is one: a cause of its own names no failed stage. An unlisted exception takes its phase's cause at LOW.
    """
    known = failures.sparkSession.createDataFrame(V.EXCEPTIONS, "phase string, exception string, root_cause string, confidence string, failure_stage string")
    other = failures.sparkSession.createDataFrame([(p, *x) for p, x in V.UNKNOWN.items()], "phase string, other_cause string, other_stage string")
    out = failures.join(F.broadcast(known), ["phase", "exception"], "left").join(F.broadcast(other), "phase", "left")
    answered, own = F.col("code").isNotNull(), W.status_cause(F.col("code"))
    cause = F.when(answered, F.coalesce(own, F.lit("UNKNOWN_FAILURE"))).otherwise(F.coalesce("root_cause", "other_cause", F.lit("UNKNOWN_FAILURE")))
    stage = F.when(answered, F.when(own.isNull(), "REDIRECT_VALIDATION")).otherwise(F.coalesce("failure_stage", "other_stage", F.lit("HTTP_REQUEST_SENT")))
    sure = F.when(answered, F.when(own.isNull(), "LOW").otherwise("HIGH")).otherwise(F.coalesce("confidence", F.lit("LOW")))
    return out.withColumns({"root_cause": cause, "failure_stage": stage, "confidence": sure}).drop("other_cause", "other_stage")


_PHASES = ("dns", "tcp", "tls", "http", "url", "policy", "redirect")
_RAISED = ("gaierror", "TimeoutError", "ReadTimeout", "ConnectionRefusedError", "HostUnreachable", "OSError", "SSLError", "SSLCertVerificationError", "RemoteProtocolError", "ConnectionResetError", "ConnectTimeout", "SourceRejected", "ValueError")


@C.query(
    f"""WITH f AS (SELECT event_id, {list(_PHASES)}[event_id % 7 + 1] AS phase, {list(_RAISED)}[event_id % 13 + 1] AS exception, CASE WHEN event_id % 3 = 0 THEN 390 + event_id % 130 END AS code FROM events),
known AS (SELECT * FROM f WHERE code IS NULL),
one AS (SELECT event_id, CASE WHEN phase = 'dns' THEN 'DNS_RESOLUTION_FAILED' WHEN phase IN ('tcp', 'tls') AND exception = 'TimeoutError' THEN 'CONNECT_TIMEOUT' WHEN phase = 'tcp' AND exception = 'HostUnreachable' THEN 'REMOTE_HOST_UNREACHABLE' WHEN phase = 'tcp' THEN 'TCP_CONNECTION_FAILED'
  WHEN phase = 'tls' THEN 'TLS_HANDSHAKE_FAILED' WHEN phase = 'http' AND exception = 'ReadTimeout' THEN 'READ_TIMEOUT' WHEN phase = 'http' AND exception IN ('RemoteProtocolError', 'ConnectionResetError') THEN 'REMOTE_SERVER_DROPPED_CONNECTION' WHEN phase = 'http' AND exception = 'ConnectTimeout' THEN 'CONNECT_TIMEOUT'
  WHEN phase = 'url' AND exception = 'ValueError' THEN 'URL_VALIDATION_FAILED' WHEN phase = 'policy' AND exception = 'SourceRejected' THEN 'POLICY_BLOCKED' WHEN phase = 'redirect' AND exception = 'SourceRejected' THEN 'REDIRECT_POLICY_BLOCKED' ELSE 'UNKNOWN_FAILURE' END AS root_cause,
  CASE WHEN (phase, exception) IN (('dns', 'gaierror'), ('tcp', 'ConnectionRefusedError'), ('tcp', 'HostUnreachable'), ('tls', 'SSLError'), ('tls', 'SSLCertVerificationError'), ('http', 'ReadTimeout'), ('http', 'RemoteProtocolError'), ('http', 'ConnectionResetError'), ('url', 'ValueError'), ('policy', 'SourceRejected'), ('redirect', 'SourceRejected')) THEN 'HIGH'
  WHEN (phase, exception) IN (('dns', 'TimeoutError'), ('tcp', 'TimeoutError'), ('tls', 'TimeoutError'), ('tcp', 'OSError')) THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
  CASE WHEN phase = 'dns' THEN 'DNS_RESOLUTION' WHEN phase = 'tcp' THEN 'TCP_CONNECT' WHEN phase = 'tls' THEN 'TLS_HANDSHAKE' WHEN phase = 'http' AND exception IN ('ReadTimeout', 'RemoteProtocolError', 'ConnectionResetError') THEN 'HTTP_RESPONSE_RECEIVED' WHEN phase = 'http' AND exception = 'ConnectTimeout' THEN 'TCP_CONNECT'
  WHEN phase = 'url' AND exception = 'ValueError' THEN 'REQUEST_CREATED' WHEN phase = 'policy' AND exception = 'SourceRejected' THEN 'POLICY_VALIDATION' WHEN phase = 'redirect' AND exception = 'SourceRejected' THEN 'REDIRECT_VALIDATION' ELSE 'HTTP_REQUEST_SENT' END AS failure_stage FROM known)
SELECT * FROM one UNION ALL SELECT event_id, CASE WHEN code = 403 THEN 'HTTP_403_BLOCKED' WHEN code = 404 THEN 'HTTP_404' WHEN code >= 500 THEN 'HTTP_500' ELSE 'UNKNOWN_FAILURE' END, CASE WHEN code IN (403, 404) OR code >= 500 THEN 'HIGH' ELSE 'LOW' END, CASE WHEN code IN (403, 404) OR code >= 500 THEN NULL ELSE 'REDIRECT_VALIDATION' END FROM f WHERE code IS NOT NULL"""
)
def exception_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every phase with every exception, and status codes: all fourteen causes."""
    k = F.col("event_id")
    rows = load(spark, sf_dir, "events").select(k, picked(_PHASES, k).alias("phase"), picked(_RAISED, k).alias("exception"), F.when(k % 3 == 0, k % 130 + 390).alias("code"))
    return classified(rows).select("event_id", "root_cause", "confidence", "failure_stage")


@C.query(
    f"""WITH {_SUPPLY} SELECT (SELECT count(*) FROM sources WHERE active) AS n_active, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS n_pending, (SELECT count(DISTINCT source) FROM documents) AS n_document_sources, (SELECT round(avg(quality), 6) FROM labels) AS accuracy, (SELECT count(*) FROM events WHERE event_type = 'error') AS n_errors"""
)
def operations_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single figures side by side."""
    n = F.count(F.lit(1))
    parts = [
        sources(spark, sf_dir).where("active").agg(n.alias("n_active")), load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").agg(n.alias("n_pending")),
        load(spark, sf_dir, "documents").agg(F.countDistinct("source").alias("n_document_sources")), load(spark, sf_dir, "labels").agg(F.round(F.avg("quality"), 6).alias("accuracy")),
        load(spark, sf_dir, "events").where("event_type = 'error'").agg(n.alias("n_errors")),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each


@C.query(
    """WITH d AS (SELECT n_nationkey AS id, n_name AS name, n_regionkey <> 3 AS tracked FROM nation), m AS (SELECT c_nationkey AS id, count(*) AS n, avg(c_acctbal) AS mean FROM customer GROUP BY c_nationkey)
SELECT id, name, tracked, CASE WHEN tracked THEN coalesce(n, 0) END AS n_documents, CASE WHEN tracked THEN round(mean, 4) END AS mean_score FROM d LEFT JOIN m USING (id)"""
)
def department_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not tracked stays null and is marked so; it never counts as 0."""
    d = load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") != 3).alias("tracked"))
    m = load(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.avg("c_acctbal").alias("mean"))
    return d.join(m, "id", "left").select("id", "name", "tracked", F.when(F.col("tracked"), F.coalesce("n", F.lit(0))).alias("n_documents"), F.when(F.col("tracked"), F.round("mean", 4)).alias("mean_score"))


@C.query(
    """WITH a AS (SELECT count(*) FILTER (event_type = 'error') AS errors, count(*) AS n, sum(value) AS bytes FROM events)
SELECT 'source_down' AS type, errors AS n FROM a WHERE errors > 0 UNION ALL SELECT 'certification_failure', (SELECT count(*) FROM labels WHERE quality = 0) FROM a WHERE (SELECT count(*) FROM labels WHERE quality = 0) > 0
UNION ALL SELECT 'storage_threshold', CAST(round(bytes) AS BIGINT) FROM a WHERE bytes > 1000
UNION ALL SELECT 'ocr_failure', count(*) FROM documents WHERE length(text) < 80 AND NOT EXISTS (SELECT 1 FROM events WHERE event_type = 'ocr') HAVING count(*) > 0"""
)
def system_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each condition that holds."""
    events = load(spark, sf_dir, "events")
    down = events.agg(F.count_if(F.col("event_type") == "error").alias("n")).select(F.lit("source_down").alias("type"), "n").where("n > 0")
    failed = load(spark, sf_dir, "labels").agg(F.count_if(F.col("quality") == 0).alias("n")).select(F.lit("certification_failure").alias("type"), "n").where("n > 0")
    full = events.agg(F.sum("value").alias("bytes")).where("bytes > 1000").select(F.lit("storage_threshold").alias("type"), F.round("bytes").cast("bigint").alias("n"))
    ran = events.where("event_type = 'ocr'").agg(F.count(F.lit(1)).alias("ran"))
    waiting = load(spark, sf_dir, "documents").where("length(text) < 80").agg(F.count(F.lit(1)).alias("n"))
    unread = waiting.crossJoin(F.broadcast(ran)).where("n > 0 and ran = 0").select(F.lit("ocr_failure").alias("type"), "n")  # one row each
    return down.unionByName(failed).unionByName(full).unionByName(unread)


_CLONES = """have AS (SELECT s_name AS name FROM supplier UNION SELECT s_name || ' (clone)' FROM supplier WHERE s_suppkey % 2 = 0 UNION SELECT s_name || ' (clone 2)' FROM supplier WHERE s_suppkey % 4 = 0 UNION SELECT s_name || ' (clone 4)' FROM supplier WHERE s_suppkey % 4 = 0)"""


def cloned(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """(name, clone): the first of "name (clone)", "name (clone 2)", ... that have(name) lacks.

    Names that look like clones are parsed to (name, number) and meet their origin in one join; the least number missing is the clone's.
    """
    rx = r"(?s)^(.*) \(clone(?: ([1-9][0-9]*))?\)$"
    number = F.when(F.regexp_extract("name", rx, 2) == "", F.lit(1)).otherwise(F.regexp_extract("name", rx, 2).try_cast("int"))
    taken = have.where(F.col("name").rlike(rx)).select(F.regexp_extract("name", rx, 1).alias("name"), number.alias("n")).where("n = 1 OR n >= 2")
    taken = taken.groupBy("name").agg(F.collect_set("n").alias("taken"))
    out = wanted.join(taken, "name", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<int>")))
    free = F.array_min(F.array_except(F.sequence(F.lit(1), F.size("taken") + 1), F.col("taken")))
    return out.select("name", F.concat("name", F.when(free == 1, " (clone)").otherwise(F.concat(F.lit(" (clone "), free.cast("string"), F.lit(")")))).alias("clone"))


@C.query(
    f"WITH {_CLONES} SELECT s_name AS name, s_name || CASE WHEN s_name || ' (clone)' NOT IN (FROM have) THEN ' (clone)' WHEN s_name || ' (clone 2)' NOT IN (FROM have) THEN ' (clone 2)' WHEN s_name || ' (clone 3)' NOT IN (FROM have) THEN ' (clone 3)' END AS clone FROM supplier"
)
def clone_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names for clones of all sources, some of which have clones already."""
    names = load(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    made = [names.select("name")] + [names.where(f"s_suppkey % {m} = 0").select(F.concat("name", F.lit(f" (clone{x})")).alias("name")) for m, x in ((2, ""), (4, " 2"), (4, " 4"))]
    return cloned(names.select("name"), reduce(DataFrame.unionByName, made))


_LIFE = "life AS (SELECT event_id, user_id, CAST(event_id * 7 % 5 AS INT) AS stage, lag(CAST(event_id * 7 % 5 AS INT)) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)"


@C.query(f"WITH {_LIFE} SELECT event_id, user_id, stage, before FROM life WHERE stage < before AND stage <> 4")
def lifecycle_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves backwards; retiring is always allowed."""
    stage = (F.col("event_id") * 7 % 5).cast("int")
    rows = load(spark, sf_dir, "events").select("event_id", "user_id", stage.alias("stage"), F.lag(stage).over(Window.partitionBy("user_id").orderBy("event_id")).alias("before"))
    return rows.where("stage < before").where(F.col("stage") != STAGES.index("RETIRED"))


@C.query(
    """WITH q AS (SELECT event_id // 10 AS request, event_id, user_id, event_type FROM events), f AS (SELECT request, min(event_id) FILTER (event_type = 'click') AS claim, min(event_id) FILTER (event_type = 'purchase') AS done FROM q GROUP BY request)
SELECT f.request, c.user_id AS agent, CASE WHEN done IS NOT NULL AND claim IS NOT NULL AND done > claim THEN 'completed' WHEN claim IS NOT NULL THEN 'claimed' ELSE 'queued' END AS status FROM f LEFT JOIN q c ON c.event_id = f.claim"""
)
def queue_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first claim of a request wins; later ones change nothing."""
    q = load(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 10).alias("request"), "event_id", "user_id", "event_type")
    first = lambda kind: F.min(F.when(F.col("event_type") == kind, F.struct("event_id", "user_id")))
    rows = q.groupBy("request").agg(first("click").alias("claim"), first("purchase").alias("done"))
    status = F.when(F.col("done.event_id") > F.col("claim.event_id"), "completed").when(F.col("claim").isNotNull(), "claimed").otherwise("queued")
    return rows.select("request", F.col("claim.user_id").alias("agent"), status.alias("status"))


@C.query(f"WITH {_NOW}, s AS (SELECT event_id AS session, user_id, ts + INTERVAL 36 HOUR AS expires FROM events WHERE event_type = 'signup') SELECT session, user_id FROM s, now WHERE expires > now AND user_id % 12 <> 0")
def valid_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events")
    rows = events.where("event_type = 'signup'").select(F.col("event_id").alias("session"), "user_id", (F.col("ts") + F.expr("INTERVAL 36 HOUR")).alias("expires"))
    return with_now(rows, events).where("expires > now and user_id % 12 <> 0").select("session", "user_id")


@C.query(
    "SELECT name, region FROM (SELECT n_name AS name, n_regionkey AS region FROM nation UNION ALL SELECT * FROM (VALUES ('NATION_X', 1), ('NATION_Y', 2)) v WHERE v.col0 NOT IN (SELECT n_name FROM nation))"
)
def registry_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeding twice changes nothing: only names that are absent are added."""
    have = load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    seed = spark.createDataFrame([("NATION_X", 1), ("NATION_Y", 2)], "name string, region int")
    once = have.unionByName(seed.join(have, "name", "left_anti").select("name", "region"))
    return once.unionByName(seed.join(once, "name", "left_anti").select("name", "region"))


def seeded(registry: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """registry with the rows of seed whose key it lacks; doing so again changes nothing. A seed that names a key twice adds it once."""
    new = seed.join(registry.select(key), key, "left_anti").dropDuplicates([key]).select(*[c for c in registry.columns])
    return registry.unionByName(new)


@C.query(
    f"""WITH have AS (SELECT s_name AS name, 'Revenue and Disaster Management' AS department, 'Normal' AS priority FROM supplier), seed(name, department, priority) AS (VALUES {", ".join(f"('{n}', '{d}', '{p}')" for n, d, p in V.SEED_SOURCES)})
SELECT * FROM have UNION ALL SELECT * FROM seed WHERE name NOT IN (SELECT name FROM have)"""
)
def source_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of sources, seeded twice."""
    have = load(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.lit("Revenue and Disaster Management").alias("department"), F.lit("Normal").alias("priority"))
    seed = spark.createDataFrame(V.SEED_SOURCES, "name string, department string, priority string")
    return seeded(seeded(have, seed, "name"), seed, "name")


@C.query(
    f"""WITH have AS (SELECT n_name AS name, n_regionkey AS state FROM nation), seed AS (SELECT unnest({list(V.DISTRICTS)}) AS name) SELECT * FROM have UNION ALL SELECT name, -1 FROM seed WHERE name NOT IN (SELECT name FROM have)"""
)
def geography_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry of districts with those of the state added that it lacks, under a state of their own."""
    have = load(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("state"))
    seed = spark.createDataFrame([(d, -1) for d in V.DISTRICTS], "name string, state int").select("name", F.col("state").cast(have.schema["state"].dataType).alias("state"))
    return seeded(seeded(have, seed, "name"), seed, "name")


@C.query(
    """WITH s AS (SELECT o_custkey AS id, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS ok, max(o_totalprice) AS top FROM orders GROUP BY o_custkey)
SELECT id, 'Source ' || id || chr(10) || 'Runs: ' || n || chr(10) || 'Succeeded: ' || ok || ' (' || 100 * ok // n || '%)' AS report FROM s"""
)
def source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("ok"))
    return rows.select("id", F.format_string("Source %d\nRuns: %d\nSucceeded: %d (%d%%)", "id", "n", "ok", F.floor(100 * F.col("ok") / F.col("n"))).alias("report"))


@C.query(
    """SELECT 'documents' AS name, count(*) FILTER (doc_id % 4 = 0) AS n_kept, count(*) FILTER (doc_id % 4 <> 0) AS n_removed FROM documents UNION ALL SELECT 'labels', count(*) FILTER (doc_id % 4 = 0), count(*) FILTER (doc_id % 4 <> 0) FROM labels"""
)
def production_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reset keeps certified documents and what depends on them; dependent tables follow by a semi-join."""
    docs, labels = load(spark, sf_dir, "documents").select("doc_id"), load(spark, sf_dir, "labels").select("doc_id")
    keep = docs.where("doc_id % 4 = 0").distinct()

    def counted(name: str, rows: DataFrame) -> DataFrame:
        marked = rows.join(keep.withColumn("kept", F.lit(True)), "doc_id", "left")
        return marked.agg(F.count("kept").alias("n_kept"), F.count_if(F.col("kept").isNull()).alias("n_removed")).select(F.lit(name).alias("name"), "n_kept", "n_removed")

    return counted("documents", docs).unionByName(counted("labels", labels))


QUERIES, ORACLE_SQL = C.queries, C.oracle_sql
