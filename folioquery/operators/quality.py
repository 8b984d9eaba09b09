"""Accuracy: scores of predictions against annotations, failure causes, calibration. labels.quality is the annotated value, a rule over
documents the prediction, and source and lang the groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions import text as T
from ..functions import vocabulary as V
from ..sources.tables import load

C = Catalog()
FIELDS = ("quality", "toxic")

_GRID = """grid AS (
  SELECT d.doc_id, f.field, d.lang, d.source, CASE f.field WHEN 'quality' THEN l.quality ELSE l.toxic END AS expected_raw, l.doc_id % 11 = 0 AS asserted_absent,
    CASE WHEN d.n_chars % 7 = 0 THEN NULL WHEN f.field = 'quality' THEN CASE WHEN d.n_chars > 300 THEN 1 ELSE 0 END ELSE CASE WHEN d.n_chars % 5 = 0 THEN 1 ELSE 0 END END AS actual,
    (d.n_chars % 100) / 100.0::DOUBLE AS confidence
  FROM labels l JOIN documents d USING (doc_id), (VALUES ('quality'), ('toxic')) f(field)),
scored AS (SELECT *, CASE WHEN asserted_absent THEN NULL ELSE expected_raw END AS expected FROM grid),
outcomes AS MATERIALIZED (SELECT *, CASE WHEN expected IS NULL AND actual IS NULL THEN 'tn' WHEN expected IS NULL THEN 'hallucinated' WHEN actual IS NULL THEN 'missed' WHEN expected = actual THEN 'tp' ELSE 'wrong' END AS outcome FROM scored)"""


def outcome(expected: Column, actual: Column, equal: Column) -> Column:
    """A null expected value asserts that there is none."""
    return F.when(expected.isNull() & actual.isNull(), "tn").when(expected.isNull(), "hallucinated").when(actual.isNull(), "missed").when(equal, "tp").otherwise("wrong")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each annotated document and field, with expected and actual value and the outcome."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = load(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("field", F.explode(F.array(*[F.lit(f) for f in FIELDS])))
    expected = F.when(F.col("doc_id") % 11 != 0, F.when(F.col("field") == "quality", F.col("quality")).otherwise(F.col("toxic")))
    guess = F.when(F.col("field") == "quality", (F.col("n_chars") > 300).cast("int")).otherwise((F.col("n_chars") % 5 == 0).cast("int"))
    rows = rows.withColumn("expected", expected).withColumn("actual", F.when(F.col("n_chars") % 7 != 0, guess)).withColumn("confidence", (F.col("n_chars") % 100) / 100.0)
    return rows.withColumn("outcome", outcome(F.col("expected"), F.col("actual"), F.col("expected") == F.col("actual")))


def counters() -> list[Column]:
    """tp, fp, fn, tn: a wrong value counts as both a false positive and a false negative."""
    n = lambda *names: F.count_if(F.col("outcome").isin(*names))
    return [n("tp").alias("tp"), n("wrong", "hallucinated").alias("fp"), n("wrong", "missed").alias("fn"), n("tn").alias("tn")]


def rates(counts: DataFrame) -> DataFrame:
    """precision, recall, f1 and accuracy; null where nothing was asked."""
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    out = counts.withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(r, 6))
    out = out.withColumn("f1", F.round(F.try_divide(F.lit(2) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn")), 6))
    return out.withColumn("accuracy", F.round(F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")), 6))


_COUNTS = "count(*) FILTER (outcome = 'tp') AS tp, count(*) FILTER (outcome IN ('wrong', 'hallucinated')) AS fp, count(*) FILTER (outcome IN ('wrong', 'missed')) AS fn, count(*) FILTER (outcome = 'tn') AS tn"
_RATES = "tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round((tp + tn) / nullif(tp + tn + fp + fn, 0), 6) AS accuracy"


@C.query(f"WITH {_GRID} SELECT doc_id, field, expected, actual, outcome FROM outcomes")
def score_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).select("doc_id", "field", "expected", "actual", "outcome")


@C.query(f"WITH {_GRID}, c AS (SELECT field, {_COUNTS} FROM outcomes GROUP BY field) SELECT field, {_RATES} FROM c")
def accuracy_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(grid(spark, sf_dir).groupBy("field").agg(*counters()))


@C.query(f"WITH {_GRID}, c AS (SELECT field, source, lang, {_COUNTS} FROM outcomes GROUP BY GROUPING SETS ((field), (source, field), (lang, field))) SELECT field, source, lang, {_RATES} FROM c")
def accuracy_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overall, by source and by language in one pass over the grid."""
    sets = [[F.col("field")], [F.col("source"), F.col("field")], [F.col("lang"), F.col("field")]]
    return rates(grid(spark, sf_dir).groupingSets(sets, "field", "source", "lang").agg(*counters()))


@C.query(
    f"""WITH {_GRID}, c AS (SELECT field, {_COUNTS} FROM outcomes GROUP BY field), r AS (SELECT field, {_RATES} FROM c)
SELECT field, CASE field WHEN 'quality' THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS target, coalesce(accuracy >= CASE field WHEN 'quality' THEN 0.5 ELSE 0.9 END, true) AS passed, bool_and(coalesce(accuracy >= CASE field WHEN 'quality' THEN 0.5 ELSE 0.9 END, true)) OVER () AS all_passed FROM r"""
)
def target_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields against their targets; a field that nothing supports does not fail."""
    targets = {"quality": 0.5, "toxic": 0.9}
    rows = accuracy_overall(spark, sf_dir).withColumn("target", T.looked_up(F.col("field"), targets))
    rows = rows.withColumn("passed", F.coalesce(F.col("accuracy") >= F.col("target"), F.lit(True))).select("field", "target", "passed")
    return rows.crossJoin(F.broadcast(rows.agg(F.coalesce(F.bool_and("passed"), F.lit(True)).alias("all_passed"))))  # one row


_CAUSE = """causes AS MATERIALIZED (SELECT doc_id, field, lang, source, outcome, CASE WHEN outcome = 'hallucinated' THEN 'hallucination' WHEN doc_id % 13 = 0 THEN 'ocr_failure' WHEN lang = 'es' THEN 'tamil_parsing_failure'
  WHEN field = 'quality' AND doc_id % 4 = 1 THEN 'reference_misclassification' WHEN field = 'toxic' AND doc_id % 3 = 0 THEN 'table_extraction_failure' WHEN field = 'toxic' THEN 'budget_failure' ELSE 'other' END AS cause
  FROM outcomes WHERE outcome IN ('wrong', 'missed', 'hallucinated'))"""


def cause(kind: Column, scanned: Column, other_script: Column, cited: Column, table_heavy: Column, field: Column, reference_fields: tuple[str, ...] = ("go_number", "go_date"), table_fields: tuple[str, ...] = ("budget", "district")) -> Column:
    """Why a value failed: the first of these that holds."""
    return (
        F.when(kind == "hallucinated", "hallucination").when(scanned, "ocr_failure").when(other_script, "tamil_parsing_failure")
        .when(field.isin(*reference_fields) & cited, "reference_misclassification").when(table_heavy & field.isin(*table_fields), "table_extraction_failure")
        .when(field == table_fields[0], "budget_failure").when(field == table_fields[-1], "district_failure").otherwise("other")
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = grid(spark, sf_dir).where(F.col("outcome").isin("wrong", "missed", "hallucinated"))
    d = F.col("doc_id")
    why = cause(F.col("outcome"), d % 13 == 0, F.col("lang") == "es", d % 4 == 1, d % 3 == 0, F.col("field"), ("quality",), ("toxic",))
    return rows.select("doc_id", "field", "lang", "source", "outcome", why.alias("cause"))


@C.query(f"WITH {_GRID}, {_CAUSE} SELECT doc_id, field, cause FROM causes")
def failure_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures(spark, sf_dir).select("doc_id", "field", "cause")


@C.query(f"WITH {_GRID}, {_CAUSE} SELECT cause, count(*) AS n FROM causes GROUP BY cause ORDER BY n DESC, cause LIMIT 5")
def failure_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failures(spark, sf_dir).groupBy("cause").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cause").limit(5)


@C.query(f"WITH {_GRID}, {_CAUSE}, runs AS (SELECT DISTINCT doc_id // 100 AS run FROM documents), newest AS (SELECT run FROM runs ORDER BY run DESC LIMIT 5) SELECT n.run, count(c.doc_id) AS n FROM newest n LEFT JOIN causes c ON c.doc_id // 100 = n.run GROUP BY n.run ORDER BY n.run")
def failure_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five runs in the order of time; a run without failures counts 0."""
    runs = load(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 100).alias("run")).distinct().orderBy(F.desc("run")).limit(5)
    rows = failures(spark, sf_dir).select(F.floor(F.col("doc_id") / 100).alias("run"), "doc_id")
    return runs.join(rows, "run", "left").groupBy("run").agg(F.count("doc_id").alias("n")).orderBy("run")


@C.query(
    f"WITH {_GRID}, {_CAUSE}, m AS MATERIALIZED (SELECT source, lang FROM causes) SELECT 'source' AS by, coalesce(source, 'unknown') AS value, count(*) AS n FROM m GROUP BY source UNION ALL SELECT 'lang', coalesce(lang, 'unknown'), count(*) FROM m GROUP BY lang"
)
def failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grouped by the raw column, so a null and a literal 'unknown' stay apart."""
    rows = failures(spark, sf_dir)
    one = lambda c: rows.groupBy(c).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("by"), F.coalesce(c, F.lit("unknown")).alias("value"), "n")
    return one("source").unionByName(one("lang"))


def bucketed(observations: DataFrame, *keys: str) -> DataFrame:
    """Calibration by tenths of confidence: mean confidence, accuracy and their gap."""
    tenth = F.least(F.floor(F.greatest("confidence", F.lit(0.0)) / 0.1), F.lit(9)).cast("bigint")
    out = observations.withColumn("bucket", tenth).groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean"), F.avg(F.col("correct").cast("double")).alias("right"))
    return out.select(*keys, "bucket", "n", F.round("mean", 6).alias("mean_confidence"), F.round("right", 6).alias("accuracy"), F.round(F.col("right") - F.col("mean"), 4).alias("gap"))


_OBSERVED = "observed AS MATERIALIZED (SELECT doc_id, field, confidence, CASE WHEN outcome IN ('tp') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS correct, CAST(least(floor(confidence / 0.1::DOUBLE), 9) AS BIGINT) AS bucket FROM outcomes WHERE actual IS NOT NULL)"
_BUCKET = "count(*) AS n, round(avg(confidence), 6) AS mean_confidence, round(avg(correct), 6) AS accuracy, round(avg(correct) - avg(confidence), 4) AS gap"


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir).where("actual is not null").select("doc_id", "field", "confidence", (F.col("outcome") == "tp").alias("correct"))


@C.query(f"WITH {_GRID}, {_OBSERVED} SELECT field, bucket, {_BUCKET} FROM observed GROUP BY field, bucket")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucketed(observations(spark, sf_dir), "field")


@C.query(f"WITH {_GRID}, {_OBSERVED} SELECT bucket, {_BUCKET} FROM observed GROUP BY bucket")
def calibration_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucketed(observations(spark, sf_dir))


@C.query(f"WITH {_GRID}, {_OBSERVED}, b AS (SELECT bucket, {_BUCKET} FROM observed GROUP BY bucket) SELECT round(sum(abs(gap) * n) / sum(n), 4) AS error FROM b")
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calibration_pooled(spark, sf_dir).agg(F.round(F.sum(F.abs("gap") * F.col("n")) / F.sum("n"), 4).alias("error"))


@C.query(
    r"""WITH w AS (SELECT doc_id, list_distinct([x for x in string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') if x <> '']) AS words FROM documents),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.words AS wa, b.words AS wb FROM w a JOIN w b ON b.doc_id = a.doc_id + 1)
SELECT a, b, CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(wa, wb)) / len(list_distinct(list_concat(wa, wb))), 6) END AS overlap FROM p"""
)
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word overlap of each document with the next."""
    docs = load(spark, sf_dir, "documents").select("doc_id", T.compared(F.col("text")).alias("folded"))
    nxt = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("folded").alias("other"))
    return docs.join(nxt, "doc_id").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), F.round(T.overlap(F.col("folded"), F.col("other")), 6).alias("overlap"))


@C.query(
    """WITH a AS (SELECT doc_id, quality, toxic, doc_id % 3 <> 0 AS has_quality, doc_id % 4 <> 0 AS has_toxic FROM labels)
SELECT doc_id, CAST(CAST(has_quality AS INT) + CAST(has_toxic AS INT) AS BIGINT) AS n_fields, has_quality AND has_toxic AS complete FROM a"""
)
def golden_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every required field is annotated; a field annotated as absent is annotated."""
    rows = load(spark, sf_dir, "labels").select("doc_id", F.array_compact(F.array(F.when(F.col("doc_id") % 3 != 0, "quality"), F.when(F.col("doc_id") % 4 != 0, "toxic"))).alias("have"))
    required = F.array(*[F.lit(f) for f in FIELDS])
    return rows.select("doc_id", F.size("have").cast("bigint").alias("n_fields"), (F.size(F.array_except(required, "have")) == 0).alias("complete"))


QUERIES, ORACLE_SQL = C.queries, C.oracle_sql
