"""Stored documents: fingerprints, versions, supersede chains, duplicates, integrity, text quality and categories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import Catalog
from ..functions import text as T
from ..functions import vocabulary as V
from ..sources.tables import load

C = Catalog()
WEAK_CHARS = 80


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, source, text, sha256, path, size): content is addressed by its hash."""
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    out = docs.select("doc_id", "source", "text", sha.alias("sha256"), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("size"))
    return out.withColumn("path", F.concat_ws("/", F.substring("sha256", 1, 2), F.substring("sha256", 3, 2), F.concat("sha256", F.lit(".txt"))))


STORED = """stored AS (SELECT doc_id, source, coalesce(text, '') AS text, sha256(coalesce(text, '')) AS sha256, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size FROM documents)"""


@C.query(
    f"WITH {STORED} SELECT sha256, substr(sha256, 1, 2) || '/' || substr(sha256, 3, 2) || '/' || sha256 || '.txt' AS path, min(size) AS size, count(*) AS n_stored, count(*) > 1 AS deduplicated, min(doc_id) AS first_doc FROM stored GROUP BY sha256"
)
def fingerprint_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return stored(load(spark, sf_dir, "documents")).groupBy("sha256", "path").agg(F.min("size").alias("size"), n.alias("n_stored"), (n > 1).alias("deduplicated"), F.min("doc_id").alias("first_doc"))


@C.query(f"WITH {STORED} SELECT count(*) AS n_documents, CAST(coalesce(sum(size), 0) AS BIGINT) AS total_bytes, count(DISTINCT sha256) AS n_distinct, count(DISTINCT source) AS n_sources FROM stored")
def repository_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(load(spark, sf_dir, "documents"))
    return rows.agg(F.count(F.lit(1)).alias("n_documents"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.countDistinct("sha256").alias("n_distinct"), F.countDistinct("source").alias("n_sources"))


@C.query(
    f"""WITH {STORED}, swept AS (SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN 'missing' WHEN doc_id % 17 = 0 THEN 'mismatch' ELSE 'ok' END AS state FROM stored)
SELECT s.state, count(w.doc_id) AS n FROM (VALUES ('missing'), ('mismatch'), ('ok'), ('unreadable')) s(state) LEFT JOIN swept w USING (state) GROUP BY s.state"""
)
def integrity_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded hashes against the stored bytes; every state has a row, also those that no document is in."""
    rows = stored(load(spark, sf_dir, "documents"))
    recorded = rows.select("doc_id", F.when(F.col("doc_id") % 17 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.col("sha256")).alias("recorded"))
    kept = rows.where(F.col("doc_id") % 23 != 0).select("doc_id", "sha256")
    state = F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("recorded"), "mismatch").otherwise("ok")
    counts = recorded.join(kept, "doc_id", "left").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return zero_filled(counts, "state", ("missing", "mismatch", "ok", "unreadable"))


def zero_filled(counts: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """counts(column, n) with a row for each of a closed list of values."""
    every = counts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(v) for v in values])).alias(column))
    return every.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def versions(rows: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """A new version where content differs from the row just before; each points to the one it supersedes."""
    by = Window.partitionBy(key).orderBy(order)
    last = F.lag(content).over(by)
    kept = rows.withColumn("_new", last.isNull() | (last != F.col(content))).where("_new").drop("_new")
    return kept.withColumn("version", F.row_number().over(by).cast("bigint")).withColumn("supersedes", F.lag(order).over(by)).withColumn("superseded_by", F.lead(order).over(by))


_VERSIONED = """versioned AS (SELECT o_custkey AS name, o_orderkey AS doc_id, o_orderpriority AS content FROM orders),
flagged AS (SELECT *, lag(content) OVER w AS last FROM versioned WINDOW w AS (PARTITION BY name ORDER BY doc_id)),
kept AS (SELECT * FROM flagged WHERE last IS NULL OR last <> content)"""


@C.query(
    f"WITH {_VERSIONED} SELECT name, doc_id, content, row_number() OVER w AS version, lag(doc_id) OVER w AS supersedes, lead(doc_id) OVER w AS superseded_by FROM kept WINDOW w AS (PARTITION BY name ORDER BY doc_id)"
)
def version_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "orders").where("o_orderpriority is not null").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("content"))
    return versions(docs, "name", "doc_id", "content")


@C.query(f"WITH {_VERSIONED} SELECT name, max_by(content, doc_id) AS content, max(doc_id) AS doc_id, count(*) AS n_versions FROM kept GROUP BY name")
def current_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of each chain that nothing supersedes."""
    rows = version_history(spark, sf_dir)
    return rows.where("superseded_by is null").select("name", "content", "doc_id", F.col("version").alias("n_versions"))


@C.query(
    "SELECT doc_id, sha256(text) AS sha256, CASE WHEN doc_id % 4 = 0 THEN 'disk' ELSE 'blob' END AS read_from, doc_id % 4 = 0 AND doc_id % 8 <> 0 AS backfilled FROM documents WHERE NOT (doc_id % 4 = 0 AND doc_id % 8 = 0)"
)
def blob_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes from the blob table, else from disk; documents that only the disk has are to be copied over."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    blobs = docs.where("doc_id % 4 <> 0").select("doc_id", F.col("text").alias("blob"))
    disk = docs.where("doc_id % 8 <> 0").select("doc_id", F.col("text").alias("disk"))
    missing = disk.join(blobs, "doc_id", "left_anti").select("doc_id", F.lit(True).alias("backfilled"))
    out = docs.select("doc_id").join(blobs, "doc_id", "left").join(disk, "doc_id", "left").join(missing, "doc_id", "left").where("blob is not null or disk is not null")
    return out.select("doc_id", F.sha2(F.coalesce("blob", "disk"), 256).alias("sha256"), F.when(F.col("blob").isNull(), "disk").otherwise("blob").alias("read_from"), F.coalesce("backfilled", F.lit(False)).alias("backfilled"))


@C.query(
    r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n|\r|\f', chr(10), 'g'), '[ \t]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents"
)
def text_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", T.normalized(F.col("text")).alias("text"))


def pages_of(docs: DataFrame, size: int = 1200) -> DataFrame:
    """(doc_id, page, text): slices of size characters."""
    n = F.greatest(F.ceil(F.length("text") / size), F.lit(1)).cast("int")
    out = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(1), n)).alias("page"))
    return out.select("doc_id", "page", F.substring("text", (F.col("page") - 1) * size + 1, F.lit(size)).alias("text"))


def quality(pages: DataFrame, ceiling: float = 1.0, places: int = 4) -> DataFrame:
    """Confidence in a document's text layer, and whether it needs OCR: density, coverage, and signs that failed to decode."""
    chars = F.length("text")
    early = F.when(F.col("page") <= 5, chars).otherwise(0)
    garbled = F.when(F.col("page") <= 5, chars - F.length(F.replace("text", F.lit("�"), F.lit("")))).otherwise(0)
    out = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.sum(chars).alias("n_chars"), F.sum((chars < WEAK_CHARS).cast("int")).alias("n_empty"), F.sum(early).alias("early"), F.sum(garbled).alias("garbled")
    )
    per_page, empty = F.col("n_chars") / F.col("n_pages"), F.col("n_empty") / F.col("n_pages")
    raw = (0.6 * F.least(per_page / 1200.0, F.lit(1.0)) + 0.4 * (1.0 - empty)) * ceiling - F.least(F.col("garbled") / F.greatest("early", F.lit(1)) * 20, F.lit(0.5))
    confidence = F.when(F.col("n_chars") == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(raw, F.lit(1.0))), places))
    return out.select("doc_id", "n_pages", "n_chars", confidence.alias("confidence"), ((per_page < WEAK_CHARS) | (empty > 0.5)).alias("needs_ocr"))


_PAGES = """pages_of AS (SELECT doc_id, p AS page, substr(text, CAST((p - 1) * 1200 + 1 AS BIGINT), 1200) AS text FROM (SELECT doc_id, text, unnest(generate_series(1, greatest(CAST(ceil(length(text) / 1200) AS BIGINT), 1))) AS p FROM documents)),
sums AS (SELECT doc_id, count(*) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS n_chars, sum(CASE WHEN length(text) < 80 THEN 1 ELSE 0 END) AS n_empty,
  sum(CASE WHEN page <= 5 THEN length(text) ELSE 0 END) AS early, sum(CASE WHEN page <= 5 THEN length(text) - length(replace(text, '�', '')) ELSE 0 END) AS garbled FROM pages_of GROUP BY doc_id),
scored AS (SELECT *, CASE WHEN n_chars = 0 THEN 0.0::DOUBLE ELSE round(greatest(0.0::DOUBLE, least((0.6::DOUBLE * least(n_chars / n_pages / 1200.0::DOUBLE, 1.0::DOUBLE) + 0.4::DOUBLE * (1.0::DOUBLE - n_empty / n_pages)) - least(garbled / greatest(early, 1) * 20, 0.5::DOUBLE), 1.0::DOUBLE)), 8) END AS confidence,
  n_chars / n_pages < 80 OR n_empty / n_pages > 0.5 AS needs_ocr FROM sums)"""


@C.query(f"WITH {_PAGES} SELECT doc_id, n_pages, n_chars, confidence, needs_ocr FROM scored")
def text_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(pages_of(load(spark, sf_dir, "documents").where("text is not null")), places=8)  # so that no tie is rounded


@C.query(f"WITH {_PAGES} SELECT needs_ocr, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM scored GROUP BY needs_ocr")
def ocr_needs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_quality(spark, sf_dir).groupBy("needs_ocr").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


_SCRIPTS = """counted AS (SELECT doc_id, CAST(length(regexp_replace(text, '[^À-ÖØ-öø-ÿ]', '', 'g')) AS BIGINT) AS first, CAST(length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS BIGINT) AS second FROM documents)"""


@C.query(
    f"WITH {_SCRIPTS} SELECT doc_id, first, second, CASE WHEN first + second = 0 THEN 'unknown' WHEN first / (first + second) >= 0.85 THEN 'latin1' WHEN second / (first + second) >= 0.85 THEN 'english' ELSE 'mixed' END AS language FROM counted"
)
def script_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The script that dominates a text; here accented Latin against plain Latin letters."""
    first, second = T.script_counts(F.col("text"), "À-ÖØ-öø-ÿ")
    out = load(spark, sf_dir, "documents").select("doc_id", first.alias("first"), second.alias("second"))
    return out.withColumn("language", T.language(F.col("first"), F.col("second"), ("latin1", "english")))


def flags(mention: str = r"(?i)(?=A)\bANNEXURE\b") -> list[Column]:
    """Aggregates over a document's pages: whether it is heavy on annexures (over 5 pages, or 2 mentions) or on tables (6 lines of 3 columns).

    The pattern of such lines looks only at the edges of columns, so a line of any length without gaps is read once; pages without gaps have none.
    """
    mentions = F.sum(F.size(F.regexp_extract_all("text", F.lit(mention), F.lit(0))))
    gaps = F.contains("text", F.lit("\t")) | F.contains("text", F.lit("  "))
    lines = F.sum(F.when(gaps, F.size(F.filter(F.split("text", "\n"), lambda x: x.rlike(V.TABLE_LINE)))).when(~gaps, 0))
    return [((F.count(F.lit(1)) > 5) | (mentions >= 2)).alias("annexure_heavy"), (lines >= 6).alias("table_heavy")]


def category_flags(pages: DataFrame, mention: str | None = None) -> DataFrame:
    """(doc_id, annexure_heavy, table_heavy) of pages(doc_id, page, text), see flags."""
    return pages.groupBy("doc_id").agg(*(flags() if mention is None else flags(mention)))


@C.query(
    f"""WITH {_PAGES} SELECT doc_id, count(*) > 5 OR sum(len(regexp_extract_all(text, '\\b(?:The|the)\\b'))) >= 2 AS annexure_heavy, false AS table_heavy FROM pages_of GROUP BY doc_id"""
)
def category_flag_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The data has no annexures, so mentions of an article stand for them; no line of it has columns."""
    return category_flags(pages_of(load(spark, sf_dir, "documents").where("text is not null")), r"\b(?:The|the)\b")


@C.query(
    """WITH said AS (SELECT source, min(doc_id) AS doc_id, CASE source WHEN 'src0' THEN 'Health and Family Welfare' WHEN 'src1' THEN 'School Education' WHEN 'src2' THEN 'Public Works' WHEN 'src3' THEN 'Rural Development and Panchayat Raj' ELSE 'Finance' END AS department, count(*) AS n FROM documents GROUP BY source),
b AS (SELECT CASE department WHEN 'Health and Family Welfare' THEN 'health' WHEN 'School Education' THEN 'education' WHEN 'Public Works' THEN 'public_works' WHEN 'Rural Development and Panchayat Raj' THEN 'rural_development' ELSE 'other' END AS bucket, n FROM said)
SELECT t.bucket, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS n, CAST(50 AS BIGINT) AS target, coalesce(sum(b.n), 0) >= 50 AS met FROM (VALUES ('health'), ('education'), ('public_works'), ('rural_development')) t(bucket) LEFT JOIN b USING (bucket) GROUP BY t.bucket"""
)
def acquisition_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each department bucket against its target."""
    names = {"src0": "Health and Family Welfare", "src1": "School Education", "src2": "Public Works", "src3": "Rural Development and Panchayat Raj"}
    docs = load(spark, sf_dir, "documents").select(T.bucket(F.coalesce(T.looked_up(F.col("source"), names), F.lit("Finance"))).alias("bucket"))
    counts = docs.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    out = zero_filled(counts, "bucket", tuple(V.BUCKET_TARGETS))
    target = T.looked_up(F.col("bucket"), V.BUCKET_TARGETS).cast("bigint")
    return out.select("bucket", "n", target.alias("target"), (F.col("n") >= target).alias("met"))


def ocr_merged(pages: DataFrame, ocr: DataFrame, floor: float = 0.35) -> DataFrame:
    """pages(doc_id, page, text) where weak pages take the text of their newest OCR run if it is longer and sure enough. ocr(doc_id, page, run, text, word_confidence)"""
    latest = ocr.groupBy("doc_id", "page").agg(F.max_by(F.struct(F.col("text").alias("ocr_text"), "word_confidence"), "run").alias("latest"))
    both = pages.join(latest.select("doc_id", "page", "latest.*"), ["doc_id", "page"], "left")
    better = (F.length("text") < WEAK_CHARS) & (F.length("ocr_text") > F.length("text")) & (F.col("word_confidence") >= floor)
    better = F.coalesce(better, F.lit(False))
    return both.select("doc_id", "page", F.when(better, F.col("ocr_text")).otherwise(F.col("text")).alias("text"), better.alias("improved"), F.when(better, F.col("word_confidence")).alias("word_confidence"))


_OCR = """digital AS (SELECT conv_id AS doc_id, turn AS page, text FROM conversations WHERE role = 'user'),
runs AS (SELECT conv_id AS doc_id, turn - 1 - turn % 2 AS page, turn AS run, text, (turn % 5 + 1) / 6.0::DOUBLE AS word_confidence FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT conv_id, turn - 1, turn, text, (turn % 5 + 1) / 6.0::DOUBLE FROM conversations WHERE role = 'assistant'),
ocr AS (SELECT doc_id, page, text, word_confidence FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY run DESC) = 1),
merged AS (SELECT d.doc_id, d.page, coalesce(length(d.text) < 80 AND length(o.text) > length(d.text) AND o.word_confidence >= 0.35, false) AS improved, d.text AS digital, o.text AS ocr_text, o.word_confidence FROM digital d LEFT JOIN ocr o USING (doc_id, page))"""


@C.query(f"WITH {_OCR} SELECT doc_id, CAST(page AS BIGINT) AS page, improved, CASE WHEN improved THEN ocr_text ELSE digital END AS text FROM merged")
def ocr_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages: what users say is the digital text, what assistants answer the OCR runs of the page before."""
    digital, ocr = _read_pages(spark, sf_dir)
    return ocr_merged(digital, ocr).select("doc_id", "page", "improved", "text")


def _read_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    said = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "role", "text")
    turn = F.col("turn")
    answers = said.where("role = 'assistant'").select("doc_id", turn.alias("run"), "text", ((turn % 5 + 1) / 6.0).alias("word_confidence"), F.explode(F.array(turn - 1, turn - 1 - turn % 2)).alias("page"))
    return said.where("role = 'user'").select("doc_id", turn.alias("page"), "text"), answers.distinct()


@C.query(
    f"""WITH {_OCR}, s AS (SELECT doc_id, count(*) AS n_pages, sum(length(CASE WHEN improved THEN ocr_text ELSE digital END)) AS n_chars, sum(CASE WHEN length(CASE WHEN improved THEN ocr_text ELSE digital END) < 80 THEN 1 ELSE 0 END) AS n_empty, sum(CASE WHEN improved THEN 1 ELSE 0 END) AS n_improved, avg(CASE WHEN improved THEN word_confidence END) AS words FROM merged GROUP BY doc_id)
SELECT doc_id, n_improved > 0 AS ocr_applied, CAST(n_improved AS BIGINT) AS n_improved, n_empty > 0 AS still_needs_ocr,
  round(round(greatest(0.0::DOUBLE, least((0.6::DOUBLE * least(n_chars / n_pages / 1200.0::DOUBLE, 1.0::DOUBLE) + 0.4::DOUBLE * (1.0::DOUBLE - n_empty / n_pages)) * 0.97::DOUBLE, 1.0::DOUBLE)), 8) * (0.5::DOUBLE + 0.5::DOUBLE * words), 6) AS confidence FROM s WHERE n_improved > 0"""
)
def ocr_rescored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with improved pages, scored anew and discounted by the OCR's own confidence."""
    digital, ocr = _read_pages(spark, sf_dir)
    merged = ocr_merged(digital, ocr)
    base = quality(merged, V.BACKEND_CEILINGS["pdfplumber"], 8).select("doc_id", "confidence")
    own = merged.groupBy("doc_id").agg(F.sum(F.col("improved").cast("bigint")).alias("n_improved"), F.max(F.length("text") < WEAK_CHARS).alias("still_needs_ocr"), F.avg("word_confidence").alias("words"))
    out = own.where("n_improved > 0").join(base, "doc_id")
    return out.select("doc_id", F.lit(True).alias("ocr_applied"), "n_improved", "still_needs_ocr", F.round(F.col("confidence") * (0.5 + 0.5 * F.col("words")), 6).alias("confidence"))


@C.query(
    """SELECT conv_id, turn, coalesce(last_value(CASE WHEN role = 'system' THEN 'body' WHEN text LIKE '%the %' THEN 'references' END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'header') AS carried FROM conversations"""
)
def region_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last marker seen on an earlier page of the same document."""
    marker = F.when(F.col("role") == "system", "body").when(F.contains("text", F.lit("the ")), "references")
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.last(marker, ignorenulls=True).over(by), F.lit("header")).alias("carried"))


def joined_pages(pages: DataFrame, key: str, page: str, text: str, separator: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(page, text))), lambda x: x[text]), separator)


@C.query("SELECT conv_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn) AS full_text FROM conversations GROUP BY conv_id")
def full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "conversations")
    return rows.groupBy("conv_id").agg(joined_pages(rows, "conv_id", "turn", "text", "\n---\n").alias("full_text"))


@C.query(
    """WITH k AS (SELECT l_orderkey, l_linenumber, count(*) AS n, max(l_partkey * 100000 + l_suppkey) AS newest FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
SELECT l_orderkey, l_linenumber, n, newest, n - 1 AS n_removable FROM k"""
)
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with several pending rows, the newest, and how many would go."""
    rows = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("newest"))
    return rows.where("n > 1").withColumn("n_removable", F.col("n") - 1)


_RANKED = "SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_shipdate DESC) AS place FROM lineitem"


def newest(rows: DataFrame) -> DataFrame:
    order = [F.desc(c) for c in ("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*order)))


@C.query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM ({_RANKED}) WHERE place = 1")
def dedup_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return newest(load(spark, sf_dir, "lineitem")).where("place = 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@C.query(f"SELECT o_orderpriority, CAST(sum(CASE WHEN place > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_removable FROM ({_RANKED}) JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'P' GROUP BY o_orderpriority")
def duplicate_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = load(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    rows = newest(load(spark, sf_dir, "lineitem")).join(pending, "l_orderkey")
    return rows.groupBy("o_orderpriority").agg(F.sum((F.col("place") > 1).cast("bigint")).alias("n_removable"))


@C.query(
    """WITH t AS (SELECT doc_id, trim(text) AS text, length(text) AS n FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'given-' || doc_id WHEN doc_id % 5 = 0 THEN 'old-' || doc_id ELSE '' END AS value FROM t"""
)
def annotation_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank, then what exists, then what is supplied; blanks never overwrite."""
    docs = load(spark, sf_dir, "documents").select("doc_id")
    key = F.col("doc_id").cast("string")
    existing = docs.where("doc_id % 5 = 0").select("doc_id", F.concat(F.lit("old-"), key).alias("existing"))
    supplied = docs.where("doc_id % 3 = 0 or doc_id % 10 = 0").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("given-"), key)).otherwise("  ").alias("supplied"))
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return docs.join(existing, "doc_id", "left").join(supplied, "doc_id", "left").select("doc_id", F.coalesce(blank("supplied"), blank("existing"), F.lit("")).alias("value"))


QUERIES, ORACLE_SQL = C.queries, C.oracle_sql
