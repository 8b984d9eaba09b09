"""Fuzzy comparison of texts by their words, of all pairs of two tables, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions import text as T
from ..sources.tables import load

C = Catalog()


def word_sets(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words): the distinct words of each folded text, sorted; texts without words are left out."""
    words = F.array_sort(F.array_distinct(F.filter(F.split(T.compared(F.col(text)), " "), lambda w: w != "")))
    return rows.select(F.col(key), words.alias("words")).where(F.size("words") > 0)


def overlapping(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left key, right key, overlap): all pairs of left(key, words) and right(key, words) whose Jaccard similarity is at least `least`.

    An exact prefix-filter join. Words count from the rarest on by the number of right sets that have them, so words that right lacks come first and
    are never moved. A pair at the threshold shares at least ceil(least * n) words with a set of n, so it shares one of the first
    n - ceil(least * n) + 1 of each side: only those are posted and joined, between sets whose sizes fit. Equal sets are joined once. Candidates
    are verified on whole sets. A word that very many texts have is posted by short sets alone.
    """
    a, b = left.columns[0], right.columns[0]
    named = lambda df, side: df.select("words").distinct().select(F.sha2(F.array_join("words", " "), 256).alias(side), "words", F.size("words").alias("n"))
    one, two = named(left, "l"), named(right, "r")
    frequency = two.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("f"))
    needed = F.ceil(F.round(F.col("n") * F.lit(least), 9)).cast("int")

    def prefixes(sets: DataFrame, side: str) -> DataFrame:
        known = sets.select(side, "n", F.explode("words").alias("word")).join(frequency, "word").groupBy(side, "n").agg(F.array_sort(F.collect_list(F.struct("f", "word"))).alias("known"))
        spare = F.size("known") - needed + 1  # of the words that right has too, those within the prefix
        return known.where(spare > 0).select(side, "n", F.explode(F.slice("known", F.lit(1), spare)).alias("w")).select(side, "n", F.col("w.word").alias("word"))

    fits = (F.col("m") >= F.round(F.col("n") * F.lit(least), 9)) & (F.col("n") >= F.round(F.col("m") * F.lit(least), 9))
    met = prefixes(one, "l").join(prefixes(two, "r").withColumnRenamed("n", "m"), "word").where(fits).select("l", "r").distinct()
    sides = met.join(one.select("l", F.col("words").alias("x")), "l").join(two.select("r", F.col("words").alias("y")), "r")
    shared = F.size(F.array_intersect("x", "y"))
    pairs = sides.select("l", "r", (shared / (F.size("x") + F.size("y") - shared)).alias("overlap")).where(F.col("overlap") >= least - 1e-12)
    members = lambda df, key, side: df.select(key, F.sha2(F.array_join("words", " "), 256).alias(side))
    return pairs.join(members(left, a, "l"), "l").join(members(right, b, "r"), "r").select(a, b, F.round("overlap", 6).alias("overlap"))


_WORDS = "list_distinct([x for x in string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') if x <> ''])"


@C.query(
    f"""WITH d AS (SELECT doc_id, {_WORDS} AS x FROM documents), b AS (SELECT item_id, {_WORDS} AS y FROM benchmark),
p AS (SELECT doc_id, item_id, len(list_intersect(x, y)) AS s, len(x) + len(y) AS n FROM d, b WHERE len(x) > 0 AND len(y) > 0)
SELECT doc_id, item_id, round(s / (n - s), 6) AS overlap FROM p WHERE 2 * s >= n - s"""
)
def similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and benchmark items that share at least half of their words."""
    docs, items = (word_sets(load(spark, sf_dir, t), k, "text") for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    return overlapping(docs, items, 0.5)


QUERIES, ORACLE_SQL = C.queries, C.oracle_sql
