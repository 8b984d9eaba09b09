"""Files that go out and come back: tables of several versions under one declared schema, and nested JSON with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..catalog import Catalog
from ..sources.tables import load
from ..streaming.streams import shared_folder
from .review import FIELDS, RECORDS, fields, records

C = Catalog()

# declared schemas

#: A table as its newest version declares it, and what a version without a column has instead.
DOCUMENTS = "doc_id long NOT NULL, lang string NOT NULL, n_chars long, priority string NOT NULL, reviewed_on date"
DEFAULTS = {"priority": "Normal"}



def conformed(rows: DataFrame, schema: StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """rows under a declared schema, with the names of the columns that do not fit in `misfits`.

    A column that rows lack, or an empty value of one that has a default, gets its default; others are cast, and one that cannot be, or that
    is empty where the schema forbids it, is a misfit. Columns that are not declared are left out. Names are compared as Spark compares them.
    """
    have = {c.lower(): c for c in rows.columns}
    made, bad = [], []
    for f in schema.fields:
        given = F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)
        value = given.try_cast(f.dataType) if f.name.lower() in have else given.cast(f.dataType)
        if (default := (defaults or {}).get(f.name)) is not None:
            filled = F.when(given.isNull(), F.lit(default).cast(f.dataType)).otherwise(value)
        else:
            filled = value
        lost = given.isNotNull() & value.isNull()
        bad.append(F.when(lost if f.nullable else lost | filled.isNull(), F.lit(f.name)))
        made.append(filled.alias(f.name))
    return rows.select(*made, F.array_compact(F.array(*bad)).alias("misfits"))


def read_versions(spark: SparkSession, path: str, schema: StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """A folder of Parquet files of old and new versions as one table under the newest schema; rows that do not fit say why."""
    return conformed(spark.read.option("mergeSchema", True).parquet(path), schema, defaults)


def _versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in two files: German and English ones as an old version wrote them, with neither priority nor review, the others as the newest does; where
    the number of signs is odd a French one has a blank priority, and a short one a date that is none."""
    folder = shared_folder(spark)
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    old = F.col("lang").isin("de", "en")
    docs.where(old).write.parquet(f"{folder}/documents/version=1")
    odd = F.col("n_chars") % 2 == 1
    fresh = docs.where(~old).select(
        "doc_id", "lang", "n_chars", F.when(~odd | (F.col("lang") != "fr"), "High").alias("priority"),
        F.when(F.col("n_chars") < 300, "soon").otherwise(F.concat(F.lit("2024-01-"), F.lpad((F.col("n_chars") % 28 + 1).cast("string"), 2, "0"))).alias("reviewed_on"), F.lit(1).alias("undeclared"),
    )
    fresh.write.parquet(f"{folder}/documents/version=2")
    return read_versions(spark, f"{folder}/documents", StructType.fromDDL(DOCUMENTS), DEFAULTS)


@C.query(
    """SELECT doc_id, lang, n_chars, CASE WHEN lang IN ('de', 'en') OR (lang = 'fr' AND n_chars % 2 = 1) THEN 'Normal' ELSE 'High' END AS priority,
CASE WHEN lang NOT IN ('de', 'en') THEN DATE '2024-01-01' + CAST(n_chars % 28 AS INT) END AS reviewed_on FROM documents WHERE lang IN ('de', 'en') OR n_chars >= 300"""
)
def schema_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both versions read as one table."""
    return _versioned(spark, sf_dir).where(F.size("misfits") == 0).drop("misfits")


@C.query("SELECT doc_id, 'reviewed_on' AS misfits FROM documents WHERE lang NOT IN ('de', 'en') AND n_chars < 300")
def schema_misfits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows set aside, with the columns that do not fit."""
    return _versioned(spark, sf_dir).where(F.size("misfits") > 0).select("doc_id", F.array_join("misfits", ",").alias("misfits"))


# nested JSON

RECORD = "record_id long, source_id long, status string, parsed_on date, fields array<struct<name:string, value:string, confidence:double>>"


def digest(rows: DataFrame) -> Column:
    """A sum of hashes of whole rows, the same in any order."""
    shown = F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]))
    return F.coalesce(F.sum(F.conv(F.substring(F.md5(shown), 1, 12), 16, 10).cast("decimal(38,0)")), F.lit(0)).cast("string")


def export_json(rows: DataFrame, folder: str) -> None:
    """Nested rows as JSON lines, many files, and a manifest of their number and digest, written last."""
    rows.write.option("ignoreNullFields", False).json(f"{folder}/rows")
    written = rows.sparkSession.read.schema(rows.schema).json(f"{folder}/rows")
    written.agg(F.count(F.lit(1)).alias("n_rows"), digest(written).alias("digest")).coalesce(1).write.json(f"{folder}/manifest")


def import_json(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows of an export; raises where they are not those that its manifest counted."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/rows")
    manifest = spark.read.schema("n_rows long, digest string").json(f"{folder}/manifest").first()
    found = rows.agg(F.count(F.lit(1)).alias("n_rows"), digest(rows).alias("digest")).first()
    if manifest != found:
        raise ValueError(f"the export {folder} is not what its manifest says: {found} against {manifest}")
    return rows


@C.query(
    f"""WITH {RECORDS}, {FIELDS} SELECT r.record_id, r.source_id, r.parsed_on, f.field_name AS name, f.value, f.confidence FROM records r LEFT JOIN fields f USING (record_id) WHERE r.status = 'approved'"""
)
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved records with all their fields, out as nested JSON and back, checked by the manifest."""
    held = fields(spark, sf_dir).groupBy("record_id").agg(F.array_sort(F.collect_list(F.struct(F.col("field_name").alias("name"), "value", "confidence"))).alias("fields"))
    rows = records(spark, sf_dir).where("status = 'approved'").join(held, "record_id", "left")
    folder = shared_folder(spark)
    nested = rows.select(F.col("record_id").cast("long"), F.col("source_id").cast("long"), "status", "parsed_on", "fields")
    export_json(nested.to(StructType.fromDDL(RECORD)), folder)
    back = import_json(spark, folder, RECORD).select("record_id", "source_id", "parsed_on", F.explode_outer("fields").alias("f"))
    return back.select("record_id", "source_id", "parsed_on", "f.name", "f.value", "f.confidence")


QUERIES, ORACLE_SQL = C.queries, C.oracle_sql
