"""A keyed table in buckets, into which micro-batches are folded.

A batch reads the buckets it touches, folds its rows in and writes those buckets anew under its own number; all others keep their files. A list of the
buckets it wrote, added last, makes them the current ones. A batch that is run again starts from what was there before its number and writes the same again, so
nothing is counted twice, and a batch that dies before its list leaves nothing behind that is read. Only names of buckets reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

Fold = Callable[[DataFrame, DataFrame], DataFrame]


def hashed(n: int, *keys: str) -> Column:
    """One of n buckets by the hash of keys."""
    return F.format_string("%04d", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int"))


class Store:
    def __init__(self, spark: SparkSession, folder: str, schema: str | StructType, bucket: Column):
        self.spark, self.folder, self.bucket = spark, folder, bucket
        self.schema = spark.createDataFrame([], schema).schema

    def versions(self, before: int | None = None) -> dict[str, int]:
        """The batch that last wrote each bucket that has rows, of those before a number."""
        try:
            lists = self.spark.read.schema("bucket string, full boolean, _batch int").parquet(f"{self.folder}/lists")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return {}
        lists = lists if before is None else lists.where(F.col("_batch") < before)
        newest = lists.groupBy("bucket").agg(F.max("_batch").alias("n"), F.max_by("full", "_batch").alias("full"))
        return {x["bucket"]: x["n"] for x in newest.where("full").collect()}

    def rows(self, before: int | None = None, only: Callable[[str], bool] = lambda bucket: True) -> DataFrame:
        """The current rows of all buckets, or of some, as of before a batch."""
        paths = [f"{self.folder}/rows/_batch={n}/_bucket={b}" for b, n in sorted(self.versions(before).items()) if only(b)]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, number: int, fold: Fold, reach: Callable[[list[str]], Callable[[str], bool]] | None = None) -> list[str]:
        """Fold a batch, whose rows have the columns of the store, into the buckets that they are in, or into those that reach says; the buckets written."""
        batch = batch.select(*self.schema.names).persist()
        try:
            named = [x[0] for x in batch.select(self.bucket.alias("b")).distinct().collect()]
            if not named:
                return []
            only = reach(named) if reach else set(named).__contains__
            made = fold(self.rows(number, only), batch).select(*self.schema.names).withColumn("_bucket", self.bucket)
            folder = f"{self.folder}/rows/_batch={number}"
            made.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(folder)
            full = {x[0] for x in self.spark.read.schema("_bucket string").parquet(folder).distinct().collect()}
            read = {b for b in self.versions(number) if only(b)}
            self.spark.createDataFrame([(b, b in full) for b in sorted(full | read)], "bucket string, full boolean").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/lists/_batch={number}")
            return sorted(full | read)
        finally:
            batch.unpersist()
