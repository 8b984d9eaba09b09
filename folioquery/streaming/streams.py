"""Incremental operators as Structured Streaming queries.

Each runs over a file source until it has read what is there (availableNow), with its checkpoint and output in the shared folder, and
returns what it wrote; given the folder of an earlier run it reads on from there. The results equal those of the batch SQL over the same rows, in whatever
order files come, and no Spark state grows with the input: windows, sessions and keys are folded into a stored table (see store), of which a batch writes only
the buckets that it touches, those of recent months while rows come in order; late rows reach back to the months they fall in. The
status machine holds the newest entries of each key as state, and finds what a later entry changes further back in its stored log.
"""

from __future__ import annotations

import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..catalog import Catalog
from ..sources.tables import load
from .store import Fold, Store, hashed

C = Catalog()


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which all executors share; a local one where that is unset on a local master, as in tests."""
    top = spark.sparkContext.getCheckpointDir()
    if top is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{top}/stream-{uuid.uuid4().hex}" if top else tempfile.mkdtemp(prefix="spark-")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events folder or file as a stream, some files a trigger."""
    schema = load(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10)
    path = f"{sf_dir}/events.parque[t]"  # a pattern, as a table may be one file
    return rows.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def ran(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Run to the end of the input, each batch written by its number. A folder of an earlier run is gone on with: only new files are read."""
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def finished(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """All rows of a stream without state. Each batch writes a folder of its own anew, so one that is run again after a failure adds nothing twice."""
    folder = folder or shared_folder(stream.sparkSession)
    ran(stream, folder, lambda batch, number: batch.write.mode("overwrite").parquet(f"{folder}/out/_batch={number}"))
    return stream.sparkSession.read.schema(StructType([*stream.schema.fields, StructField("_batch", IntegerType())])).parquet(f"{folder}/out").drop("_batch")


def stored(stream: DataFrame, store: Store, fold: Fold, reach: Callable[[list[str]], Callable[[str], bool]] | None = None) -> DataFrame:
    """The rows of a store after each batch of a stream was folded into it."""
    ran(stream, store.folder, lambda batch, number: store.merge(batch, number, fold, reach) and None)
    return store.rows()


def summed(keys: list[str], **merged: Callable) -> Fold:
    """A fold by keys, each other column by an aggregate that may be applied to its own results, so rows are pre-aggregated where they are."""

    def fold(old: DataFrame, batch: DataFrame) -> DataFrame:
        part = lambda df: df.groupBy(*keys).agg(*[f(c).alias(c) for c, f in merged.items()])
        return part(old.unionByName(part(batch)))

    return fold


@C.query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily_counts(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Tumbling days, kept by month."""
    rows = event_stream(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", F.lit(1).cast("long").alias("n"), F.col("value").alias("total"))
    store = Store(spark, folder or shared_folder(spark), "day string, event_type string, n long, total double", F.substring("day", 1, 7))
    return stored(rows, store, summed(["day", "event_type"], n=F.sum, total=F.sum)).withColumn("total", F.round("total", 4))


@C.query(
    "WITH w AS (SELECT event_id, user_id, unnest(generate_series(CAST(date_trunc('day', ts) AS TIMESTAMP) - INTERVAL 6 DAY, CAST(date_trunc('day', ts) AS TIMESTAMP), INTERVAL 1 DAY)) AS start FROM events WHERE event_type = 'error') SELECT strftime(start, '%Y-%m-%d') AS start, count(*) AS n FROM w GROUP BY 1"
)
def stream_rolling_failures(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Failures in windows of seven days, one a day, kept by month."""
    day = F.to_date("ts")
    starts = F.explode(F.sequence(F.date_sub(day, 6), day))
    rows = event_stream(spark, sf_dir).where("event_type = 'error'").select(starts.alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("start"), F.lit(1).cast("long").alias("n"))
    store = Store(spark, folder or shared_folder(spark), "start string, n long", F.substring("start", 1, 7))
    return stored(rows, store, summed(["start"], n=F.sum))


#: Buckets of tables that are kept by the hash of a key.
BUCKETS = 16


@C.query("SELECT user_id, event_type, min(event_id) AS first_id, max(event_id) AS last_id, count(*) AS times FROM events GROUP BY user_id, event_type")
def stream_upsert_seen(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Insert on first sight, afterwards only the last sight moves."""
    rows = event_stream(spark, sf_dir).select("user_id", "event_type", F.col("event_id").alias("first_id"), F.col("event_id").alias("last_id"), F.lit(1).cast("long").alias("times"))
    store = Store(spark, folder or shared_folder(spark), "user_id long, event_type string, first_id long, last_id long, times long", hashed(BUCKETS, "user_id"))
    return stored(rows, store, summed(["user_id", "event_type"], first_id=F.min, last_id=F.max, times=F.sum))


@C.query("SELECT user_id, event_type FROM events GROUP BY user_id, event_type")
def stream_first_seen(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Each key once: the keys of the table of sights."""
    rows = event_stream(spark, sf_dir).select("user_id", "event_type")
    store = Store(spark, folder or shared_folder(spark), "user_id long, event_type string", hashed(BUCKETS, "user_id"))
    return stored(rows, store, lambda old, batch: old.unionByName(batch.distinct()).distinct())


GAP_HOURS = 6


def sessions_merged(old: DataFrame, batch: DataFrame) -> DataFrame:
    """Sessions of (user_id, started, ended, n), old ones and new entries, joined where less than the gap lies between two of a user.

    Entries of the same half gap are one session whatever lies between, so a user's entries are folded by half gaps before they are shuffled.
    """
    cell = F.floor(F.unix_micros("started") / (GAP_HOURS * 1_800_000_000))
    rows = old.unionByName(batch.groupBy("user_id", cell.alias("cell")).agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("n").alias("n")).drop("cell"))
    mine = Window.partitionBy("user_id").orderBy("started", "ended")
    until = F.max("ended").over(mine.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.unix_micros("started") - F.unix_micros(until) < GAP_HOURS * 3_600_000_000, 0).otherwise(1)
    marked = rows.withColumn("_opens", opens).withColumn("_session", F.sum("_opens").over(mine.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("user_id", "_session").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("n").alias("n"))


@C.query(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS n FROM s GROUP BY user_id, session"""
)
def stream_sessions(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Sessions that end after six hours without an entry, kept by the month in which they end: an entry can join only sessions that end
    later than the gap before it, so a batch reads and writes the months from its first entry on."""
    rows = event_stream(spark, sf_dir).select("user_id", F.col("ts").alias("started"), F.col("ts").alias("ended"), F.lit(1).cast("long").alias("n"))
    month = F.date_format(F.col("ended"), "yyyy-MM")
    store = Store(spark, folder or shared_folder(spark), "user_id long, started timestamp, ended timestamp, n long", month)

    def reach(months: list[str]) -> Callable[[str], bool]:
        year, m = map(int, min(months).split("-"))
        first = f"{year - (m == 1)}-{(m - 2) % 12 + 1:02d}"  # the month before, as the gap may begin there
        return lambda bucket: bucket >= first

    out = stored(rows, store, sessions_merged, reach)
    return out.select("user_id", F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "n")


_STATES = {"view": "new", "click": "downloaded", "signup": "parsed", "purchase": "verified", "error": "rejected"}


#: Entries of each key that the status machine holds as state.
HELD = 64
_MOVES = "user_id long, event_id long, before string, status string, kind string, step int"


def status_moves(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What each new entry (user_id, event_id, status) of a key does, with the newest HELD entries as state, whatever order they come in.

    kind is "new" for an entry with the status before it, "moved" for one already seen whose predecessor is now another, and "late" for an entry older than all
    that are held, whose place only the log knows. An entry that comes again does nothing.
    """
    ids, held, more = state.get if state.exists else ([], [], False)
    ids, held = list(ids), list(held)
    for step, frame in enumerate(frames):
        out, fresh = [], set()
        for event_id, status in sorted(zip(frame["event_id"].tolist(), frame["status"].tolist(), strict=True)):
            at = bisect_left(ids, event_id)
            if more and at == 0 and event_id < ids[0]:
                out.append((event_id, None, status, "late"))
            elif at == len(ids) or ids[at] != event_id:
                ids.insert(at, event_id)
                held.insert(at, status)
                fresh.add(event_id)
        for i, event_id in enumerate(ids):
            if event_id in fresh or (i and ids[i - 1] in fresh):
                out.append((event_id, held[i - 1] if i else None, held[i], "new" if event_id in fresh else "moved"))
        if len(ids) > HELD:
            ids, held, more = ids[-HELD:], held[-HELD:], True
        made = pd.DataFrame(out, columns=["event_id", "before", "status", "kind"]).astype({"before": object})
        yield made.assign(user_id=key[0], step=step)[["user_id", "event_id", "before", "status", "kind", "step"]]
    state.update((ids, held, more))


def placed_late(log: DataFrame, late: DataFrame) -> DataFrame:
    """(user_id, event_id, before, status) of late entries and of those that follow them, from the log of their users."""
    mine = Window.partitionBy("user_id").orderBy("event_id")
    marked = log.join(late.select("user_id").distinct(), "user_id", "left_semi").join(late.select("user_id", "event_id", F.lit(True).alias("is_late")), ["user_id", "event_id"], "left")
    near = marked.select("*", F.lag("status").over(mine).alias("before"), F.lag("is_late").over(mine).alias("after_late"))
    return near.where("is_late OR after_late").select("user_id", "event_id", "before", "status")


@C.query(
    f"""WITH s AS (SELECT user_id, event_id, CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _STATES.items())} END AS status FROM events),
l AS (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM s) SELECT user_id, event_id, before, status FROM l WHERE before IS NULL OR before <> status"""
)
def stream_status_changes(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """A status machine for each key; setting the status that holds changes nothing. A batch writes only the changes that its entries make or undo; the
    newest word on an entry counts, and a later file may undo what an earlier one said, as the entry before has become another."""
    folder = folder or shared_folder(spark)
    status = F.create_map(*[F.lit(x) for pair in _STATES.items() for x in pair])[F.col("event_type")]
    rows = event_stream(spark, sf_dir).select("user_id", "event_id", status.alias("status"))
    moves = rows.groupBy("user_id").applyInPandasWithState(status_moves, _MOVES, "ids array<long>, held array<string>, more boolean", "append", GroupStateTimeout.NoTimeout)
    ran(moves, folder, lambda batch, number: write_moves(batch, number, folder))
    out = spark.read.schema(f"{_MOVES}, _batch int").parquet(f"{folder}/changes")
    newest = out.groupBy("user_id", "event_id").agg(F.max_by(F.struct("before", "status"), F.struct("_batch", "step")).alias("_row")).select("user_id", "event_id", "_row.*")
    return newest.where("before IS NULL OR before <> status")


def write_moves(batch: DataFrame, number: int, folder: str) -> None:
    """Add a batch of the status machine to the log and its changes to the result; entries too old for the state are placed by the log of their users."""
    spark = batch.sparkSession
    batch = batch.persist()
    bucket = hashed(BUCKETS, "user_id").alias("_bucket")
    batch.where("kind <> 'moved'").select("user_id", "event_id", "status", bucket).write.mode("overwrite").partitionBy("_bucket").parquet(f"{folder}/log/_batch={number}")
    changes = batch.where("kind = 'moved' OR (kind = 'new' AND (before IS NULL OR before <> status))")
    late = batch.where("kind = 'late'")
    touched = [x[0] for x in late.select(bucket).distinct().collect()]
    if touched:
        log = spark.read.schema("user_id long, event_id long, status string, _batch int, _bucket string").parquet(f"{folder}/log")
        log = log.where((F.col("_batch") <= number) & F.col("_bucket").isin(touched)).groupBy("user_id", "event_id").agg(F.min_by("status", "_batch").alias("status"))
        changes = changes.unionByName(placed_late(log, late).withColumns({"kind": F.lit("late"), "step": F.lit(2**31 - 1)}))
    changes.write.mode("overwrite").parquet(f"{folder}/changes/_batch={number}")
    batch.unpersist()


@C.query("SELECT event_id, user_id FROM events WHERE event_type = 'click' AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 0)")
def stream_pending_work(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """New entries without a record yet: the stream anti-joins a table."""
    done = load(spark, sf_dir, "customer").where("c_nationkey = 0").select(F.col("c_custkey").alias("user_id"))
    rows = event_stream(spark, sf_dir).where("event_type = 'click'").join(done, "user_id", "left_anti")
    return finished(rows.select("event_id", "user_id"), folder=folder)


@C.query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_id % 9 = 0 AS failed FROM events")
def stream_failure_isolation(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """A bad item is marked and never stops the batch: what cannot be read becomes null."""
    k = F.get_json_object("props", "$.k").try_cast("bigint")
    broken = F.when(F.col("event_id") % 9 == 0, F.lit("{")).otherwise(F.col("props"))
    rows = event_stream(spark, sf_dir).withColumn("failed", F.get_json_object(broken, "$.k").isNull())
    return finished(rows.select("event_id", k.alias("k"), "failed"), folder=folder)


@C.query(
    """WITH p AS (SELECT d.doc_id, d.source, sha256(d.text) AS sha256, length(d.text) < 80 AS short, d.lang <> 'en' AS has_ocr, l.doc_id IS NULL AS pending FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) WHERE d.text IS NOT NULL),
k AS (SELECT source, sha256, min(doc_id) AS record_id, count(*) AS n_pushes, min_by(short AND NOT has_ocr, doc_id) AS needs_ocr, min_by(pending, doc_id) AS pending, min(CASE WHEN has_ocr THEN doc_id END) AS ocr_id FROM p GROUP BY source, sha256)
SELECT source, sha256, record_id, CASE WHEN needs_ocr AND pending THEN ocr_id END AS reparsed_by, n_pushes, n_pushes - 1 - CAST(needs_ocr AND pending AND ocr_id IS NOT NULL AS INT) AS n_skipped, needs_ocr AND NOT (pending AND ocr_id IS NOT NULL) AS needs_ocr FROM k"""
)
def stream_ingest(spark: SparkSession, sf_dir: str, folder: str | None = None) -> DataFrame:
    """Documents as agents push them, folded into a table of contents: the first push of a content makes its record, the same bytes again change
    nothing, but a pending record that still needs OCR is parsed again by the first push that brings it. A document without text is refused."""
    schema = load(spark, sf_dir, "documents").schema
    labelled = load(spark, sf_dir, "labels").select("doc_id", F.lit(False).alias("pending")).distinct()
    pushed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).parquet(f"{sf_dir}/documents.parque[t]").where("text IS NOT NULL")
    pushed = pushed.join(labelled, "doc_id", "left")
    has_ocr = F.col("lang") != "en"
    first = F.struct(F.col("doc_id").alias("id"), ((F.length("text") < 80) & ~has_ocr).alias("needs_ocr"), F.coalesce("pending", F.lit(True)).alias("pending"))
    rows = pushed.select("source", F.sha2("text", 256).alias("sha256"), first.alias("first"), F.when(has_ocr, F.col("doc_id")).alias("ocr_id"), F.lit(1).cast("long").alias("n_pushes"))
    store = Store(spark, folder or shared_folder(spark), "source string, sha256 string, first struct<id:long,needs_ocr:boolean,pending:boolean>, ocr_id long, n_pushes long", F.substring("sha256", 1, 1))
    out = stored(rows, store, summed(["source", "sha256"], first=F.min, ocr_id=F.min, n_pushes=F.sum))
    again = F.col("first.needs_ocr") & F.col("first.pending") & F.col("ocr_id").isNotNull()
    return out.select(
        "source", "sha256", F.col("first.id").alias("record_id"), F.when(again, F.col("ocr_id")).alias("reparsed_by"), "n_pushes",
        (F.col("n_pushes") - 1 - again.cast("int")).alias("n_skipped"), (F.col("first.needs_ocr") & ~again).alias("needs_ocr"),
    )


QUERIES, ORACLE_SQL = C.queries, C.oracle_sql
