"""Tables of a data folder, and texts generated from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocabulary as V


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; the session's time zone is UTC, so that times without a zone mean what the SQL engine means."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(values: tuple[str, ...], n: Column) -> Column:
    """The value at n modulo the number of values."""
    return F.get(F.array(*[F.lit(v) for v in values]), F.pmod(n, F.lit(len(values))).cast("int"))


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each generated order says: one row for each row of orders."""
    key = F.col("o_orderkey")
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    spread = orders.repartition(parts, "o_orderkey")  # short rows, which grow to pages
    return spread.select(
        key.alias("doc_id"),
        (key % 90000 + 100).cast("int").alias("number"),
        (key % 5).cast("int").alias("form"),
        F.to_date("o_orderdate").alias("dated"),
        picked(V.DEPARTMENTS, key).alias("department"),
        picked(V.DISTRICTS, key).alias("district"),
        F.greatest(F.floor("o_totalprice"), F.lit(1)).cast("bigint").alias("amount"),
        picked(V.SCHEMES, key).alias("scheme"),
    )


def order_pages(facts: DataFrame) -> DataFrame:
    """(doc_id, page, text): two pages for each order, with decoys where orders cite other orders.

    form 0 to 4: number with series, without one, with misread letters, a bare order number, and a series with a full stop.
    """
    n = F.col("number").cast("string")
    line = (
        F.when(F.col("form") == 0, F.concat(F.lit("G.O.(Ms) No."), n))
        .when(F.col("form") == 1, F.concat(F.lit("G.O. No."), n))
        .when(F.col("form") == 2, F.concat(F.lit("G.0.{Rt.) No."), n))
        .when(F.col("form") == 3, F.concat(F.lit("Order No. "), n))
        .otherwise(F.concat(F.lit("G.O.(D).No."), n))
    )
    cited = F.when(F.col("form") == 3, "     1. Letter of the Director.\n").otherwise("     1. G.O.(Ms) No.11, Finance (BG.I) Department, Dated: 04.01.1990.\n")
    one = F.concat(
        F.lit("GOVERNMENT OF TAMIL NADU\n\nABSTRACT\n\n"), "department", F.lit(" Department - Works of the year - Orders issued.\n\n----------\n\n"),
        F.upper("department"), F.lit(" (AB-II) DEPARTMENT\n\n"), line, F.lit("          Dated: "), F.date_format("dated", "dd.MM.yyyy"),
        F.lit("\n\nRead:\n"), cited, F.lit("\nORDER:\n\n1. The Government sanction a sum of Rs."), F.col("amount").cast("string"),
        F.lit(" lakh under the "), "scheme", F.lit(" Scheme in "), "district", F.lit(" District.\n"),
    )
    two = F.concat(F.lit("To\nThe Director, "), "district", F.lit(" District.\n(BY ORDER OF THE GOVERNOR)\n"))
    pages = facts.select("doc_id", F.posexplode(F.array(one, two)).alias("at", "text"))
    return pages.select("doc_id", (F.col("at") + 1).alias("page"), "text")
