"""The operator's workbench: priority lists, one log of several entities, scopes named by a request, addresses, annotation files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import Catalog
from ..functions import text as T
from ..functions import vocabulary as V
from ..sources.tables import load, picked
from ..streaming.streams import shared_folder
from .operations import _SCOPE, _SUPPLY, scope, sources

C = Catalog()
PRIORITIES = ("Normal", "High", "Critical", "Low")
EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


@C.query(
    f"""WITH {_SUPPLY}, p AS (SELECT id, name, ['Normal', 'High', 'Critical', 'Low'][id % 4 + 1] AS priority FROM sources WHERE active)
SELECT id, name, priority, CAST(row_number() OVER (ORDER BY (priority = 'Critical') DESC, (priority = 'High') DESC, name) AS BIGINT) AS place FROM p QUALIFY place <= 25"""
)
def priority_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of active sources: critical ones, then high ones, then all others, each by name."""
    rows = sources(spark, sf_dir).where("active").select("id", "name", picked(PRIORITIES, F.col("id")).alias("priority"))
    order = [(F.col("priority") == "Critical").desc(), (F.col("priority") == "High").desc(), F.col("name")]
    page = rows.orderBy(*order).limit(25)
    return page.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("bigint"))  # 25 rows


_SLICES = """slices AS (SELECT event_id AS id, 'record' AS entity FROM events WHERE event_type = 'click' UNION ALL SELECT event_id, 'document' FROM events WHERE event_type = 'view' UNION ALL SELECT o_orderkey, 'field' FROM orders WHERE o_orderstatus = 'P')"""


@C.query(f"WITH {_SLICES} SELECT id, entity, CAST(row_number() OVER (ORDER BY id, entity) AS BIGINT) AS place FROM slices QUALIFY place <= 100")
def entity_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred entries of three logs merged by id; of one id the entity's name decides."""
    events, orders = load(spark, sf_dir, "events"), load(spark, sf_dir, "orders")
    kinds = {"record": events.where("event_type = 'click'").select("event_id"), "document": events.where("event_type = 'view'").select("event_id"), "field": orders.where("o_orderstatus = 'P'").select("o_orderkey")}
    parts = [rows.toDF("id").withColumn("entity", F.lit(kind)) for kind, rows in kinds.items()]
    page = parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy("id", "entity").limit(100)
    return page.withColumn("place", F.row_number().over(Window.orderBy("id", "entity")).cast("bigint"))  # 100 rows


def named_requests(regions: DataFrame, nations: DataFrame) -> DataFrame:
    """(request, state_name, district_name): one for each state and district, one for everything, and names that do not resolve."""
    states = regions.select(F.concat(F.lit("state:"), "r_name").alias("request"), F.col("r_name").alias("state_name"), F.lit(None).cast("string").alias("district_name"))
    districts = nations.select(F.concat(F.lit("district:"), "n_name"), F.lit(None).cast("string"), "n_name").toDF(*states.columns)
    others = [("all", None, None), ("no state", "NOWHERE", None), ("no district", None, "NOWHERE"), ("no state, a district", "NOWHERE", "NATION_1")]
    return states.unionByName(districts).unionByName(regions.sparkSession.createDataFrame(others, "request string, state_name string, district_name string"))


def in_scope(requests: DataFrame, regions: DataFrame, nations: DataFrame, active: DataFrame, by_district: DataFrame, buckets: tuple[str, ...] = ()) -> DataFrame:
    """(request, id): a district counts before a state, a state before all; a name that does not resolve gives nothing. active(id, region, department)."""
    states = regions.select(F.col("r_name").alias("state_name"), F.col("r_regionkey").alias("region"))
    districts = nations.select(F.col("n_name").alias("district_name"), F.col("n_nationkey").alias("district"))
    known = requests.join(F.broadcast(states), "state_name", "left").join(districts, "district_name", "left")
    known = known.where("(state_name IS NULL OR region IS NOT NULL) AND (district_name IS NULL OR district IS NOT NULL)")
    one = known.where("district IS NOT NULL").select("request", "district").join(by_district, "district").join(active.select("id"), "id").select("request", "id")
    two = known.where("district IS NULL AND region IS NOT NULL").select("request", "region").join(active, "region").select("request", "id")
    every = known.where("district IS NULL AND region IS NULL").select("request", F.lit(True).alias("any")).join(active.select("id", F.lit(True).alias("any")), "any").select("request", "id")
    out = one.unionByName(two).unionByName(every)
    if buckets:
        out = out.join(active.where(T.bucket(F.col("department")).isin(*buckets)).select("id"), "id", "left_semi").select("request", "id")
    return out


def _bucket(name: str) -> str:
    return next((b for key, b in V.BUCKETS if key in name.lower()), "other")


_DEPARTMENT = f"[{', '.join(repr(_bucket(d)) for d in V.DEPARTMENTS)}][id % {len(V.DEPARTMENTS)} + 1]"


@C.query(
    f"""WITH {_SCOPE}, live AS (SELECT id, region FROM sources WHERE active AND {_DEPARTMENT} IN ('health', 'education', 'other'))
SELECT 'state:' || r_name AS request, id FROM region JOIN live ON region = r_regionkey UNION ALL SELECT 'district:' || n_name, s.id FROM nation JOIN scope s ON s.district = n_nationkey JOIN live USING (id) UNION ALL SELECT 'all', id FROM live"""
)
def scope_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources for each request of names, kept to three department buckets."""
    regions, nations = load(spark, sf_dir, "region"), load(spark, sf_dir, "nation")
    active = sources(spark, sf_dir).where("active").select("id", "region", picked(V.DEPARTMENTS, F.col("id")).alias("department"))
    return in_scope(named_requests(regions, nations), regions, nations, active, scope(spark, sf_dir).select("district", "id"), ("health", "education", "other"))


_ADDRESS = "CASE c_custkey % 6 WHEN 0 THEN c_name || '@mail.example' WHEN 1 THEN c_name WHEN 2 THEN c_name || '@host' WHEN 3 THEN 'a b@mail.example' WHEN 4 THEN c_name || '@a@b.c' ELSE c_name || '@x.y.z' END"


@C.query(f"SELECT c_custkey, regexp_matches({_ADDRESS}, '^[^@\\s]+@[^@\\s]+\\.[^@\\s]+$') AS valid FROM customer")
def email_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "customer").select("c_custkey", F.expr(_ADDRESS).rlike(EMAIL).alias("valid"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation files: UTF-8, with or without a byte order mark; values trimmed, blank for none. Raises if rows lack file_name, naming their files and lines."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    columns = [c.replace("﻿", "").strip() for c in raw.columns]
    rows = raw.toDF(*columns).select([F.coalesce(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in columns])
    if "file_name" not in columns:
        raise ValueError("the annotation file has no column file_name")
    if not rows.where("file_name = ''").isEmpty():
        nameless = annotation_lines(raw, columns).where("nameless").orderBy("file", "line").limit(20).collect()
        raise ValueError("rows without file_name: " + "; ".join(f"{f} lines {[r['line'] for r in nameless if r['file'] == f]}" for f in dict.fromkeys(r["file"] for r in nameless)))
    return rows


def annotation_lines(raw: DataFrame, columns: list[str]) -> DataFrame:
    """(file, line, nameless): the line of its file at which each record begins, where a record may have several lines. A file is one task, as one that may have such records
    cannot be split; blank lines between records are not seen."""
    breaks = sum((F.coalesce(F.length(c) - F.length(F.replace(c, F.lit("\n"))), F.lit(0)) for c in (F.col(f"`{c}`") for c in raw.columns)), F.lit(0))
    name = F.col(f"`{raw.columns[columns.index('file_name')]}`")
    placed = raw.select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("turn"), (breaks + 1).alias("lines"), (F.coalesce(F.trim(name), F.lit("")) == "").alias("nameless"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1))
    return placed.select("file", (F.coalesce(before, F.lit(0)) + 2).alias("line"), "nameless")


def merged_annotations(names: DataFrame, existing: DataFrame, supplied: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """A row for each of names(file_name): what is supplied, else what exists, else blank; blanks never overwrite."""
    given = lambda frame, mark: frame.select("file_name", *[F.nullif(F.trim(c), F.lit("")).alias(f"{c}_{mark}") for c in columns])
    out = names.join(given(existing, "old"), "file_name", "left").join(given(supplied, "new"), "file_name", "left")
    return out.select("file_name", *[F.coalesce(f"{c}_new", f"{c}_old", F.lit("")).alias(c) for c in columns])


@C.query(
    """SELECT doc_id || '.pdf' AS file_name, CASE WHEN doc_id % 3 = 0 THEN 'given, "' || doc_id || '"' WHEN doc_id % 5 = 0 THEN 'old ' || doc_id ELSE '' END AS go_number, CASE WHEN doc_id % 5 = 0 THEN lang ELSE '' END AS subject FROM documents"""
)
def annotation_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An existing file merged with supplied values, written as CSV and read again."""
    folder, name, key = shared_folder(spark), F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("file_name"), F.col("doc_id").cast("string")
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    write = lambda rows, part: rows.write.option("header", True).option("escape", '"').csv(f"{folder}/{part}")
    write(docs.where("doc_id % 5 = 0").select(name, F.concat(F.lit(" old "), key).alias("go_number"), F.col("lang").alias("subject")), "existing")
    given = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('given, "'), key, F.lit('"'))).otherwise("  ")
    supplied = docs.where("doc_id % 3 = 0 or doc_id % 10 = 0").select(name, given.alias("go_number"), F.lit("").alias("subject"))
    write(merged_annotations(docs.select(name), read_annotations(spark, f"{folder}/existing"), supplied, ("go_number", "subject")), "merged")
    return read_annotations(spark, f"{folder}/merged")


QUERIES, ORACLE_SQL = C.queries, C.oracle_sql
