"""Exact dedup over an extendible-hash index on shared files [native].

Every text has a 64-bit hash key. Equal (key, text) rows are folded by comparing their bytes, first inside each map task and then across them, so a
text that a third of all rows hold reaches a shuffle once for each map task. What is left is an entry for each distinct text:
key, number of rows, largest doc_id and SHA-256. Entries are written to the shared folder, and buckets are laid out over them: the directory maps the
first `depth` bits of a key to a bucket; while a bucket holds more than CAPACITY entries of more than one key, the directory doubles and
that bucket splits, the others keep their local depth. A bucket is a range of keys, so owner tasks take ranges of buckets, sort them, number the entries
that share a key (the chain of a collision) and write the index: directory and entries, which a later job can read.

Each document then finds its entry by its key alone where one text has that key, which the comparison of bytes has proved, and by
(key, SHA-256) in a chain, whose entries have been checked to have unlike digests. Texts cross the network once, in the folding; the way back moves doc_id
and key, with the largest groups of copies spread over all tasks.

Scale: one shuffle of the distinct texts and three of rows of about a hundred bytes. The directory has a row for each slot that is in use, about two for
CAPACITY entries, and is broadcast only where Spark's own threshold allows. The driver reads two numbers a doubling.

Defined results: a null text counts as empty, so null and empty texts are copies of each other; texts are compared as they are, of any length; rows that
repeat a doc_id are counted each and stay together (kept is doc_id = keep_id, and true where no copy has a doc_id at all); an empty table gives no
rows; other columns are ignored by copies() and handed on by without_copies(), whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import fresh, shared_folder, spread_join, table

#: Entries that a bucket holds before it splits.
CAPACITY = 4096
Hash = Callable[[Column], Column]


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def slot_of(key: Column, depth: Column | int) -> Column:
    """The first depth bits of a key."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.when(depth == 0, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftrightunsigned", key, F.lit(64) - depth))


def entries(docs: DataFrame, hash_of: Hash = F.xxhash64) -> DataFrame:
    """(key, keep_id, n, sha) for each distinct text."""
    rows = docs.select("doc_id", hash_of(_text()).alias("key"), _text().alias("text"))
    return rows.groupBy("key", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).select("key", "keep_id", "n", F.sha2("text", 256).alias("sha"))


def directory(found: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, bucket, local_depth) of each used slot of the directory over entries, and the directory's depth; bucket is the bucket's least key."""
    first = depth = max(0, math.ceil(math.log2(max(1, found.count()) / capacity)))
    over = (F.col("n") > capacity) & (F.col("low") < F.col("high"))
    while True:
        slots = found.groupBy(slot_of(F.col("key"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high"))
        # keys of a slot agree on at least `same` bits, so a directory of no more bits would not split it
        same = slots.where(over).agg(F.max(F.lit(64) - F.length(F.bin(F.col("low").bitwiseXOR(F.col("high")))))).first()[0]
        if same is None:
            break
        depth = max(depth, same) + 1
    at = F.call_function("shiftrightunsigned", "slot", F.lit(depth) - F.col("local_depth"))
    nodes = slots.withColumn("local_depth", F.explode(F.sequence(F.lit(first), F.lit(depth)))).withColumn("node", at)
    closed = nodes.groupBy("local_depth", "node").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where(~over)
    own = nodes.join(closed.select("local_depth", "node"), ["local_depth", "node"]).groupBy("slot").agg(F.min("local_depth").alias("local_depth"))
    low = F.when(F.col("local_depth") == 0, F.lit(-(2**63))).otherwise(F.call_function("shiftleft", at, F.lit(64) - F.col("local_depth")))
    return own.select("slot", low.alias("bucket"), "local_depth"), depth


def build(docs: DataFrame, capacity: int = CAPACITY, hash_of: Hash = F.xxhash64) -> str:
    """Write the index of docs(doc_id, text) to a new folder of the shared one: entries, directory and index."""
    spark = docs.sparkSession
    folder = f"{shared_folder(spark)}/exact-{uuid.uuid4().hex}"
    entries(docs, hash_of).write.parquet(f"{folder}/entries")
    found = spark.read.parquet(f"{folder}/entries")
    slots, depth = directory(found, capacity)
    slots.write.parquet(f"{folder}/directory")
    placed = found.withColumn("slot", slot_of(F.col("key"), depth)).join(spark.read.parquet(f"{folder}/directory"), "slot").drop("slot")
    chain = Window.partitionBy("bucket", "key")
    owned = placed.repartitionByRange("bucket").select("*", F.row_number().over(chain.orderBy("keep_id", "sha")).alias("place"), F.count(F.lit(1)).over(chain).alias("chain"))
    owned.write.parquet(f"{folder}/index")
    return folder


def copies(docs: DataFrame, capacity: int = CAPACITY, hash_of: Hash = F.xxhash64) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of each row of docs(doc_id, text)."""
    index = docs.sparkSession.read.parquet(f"{build(docs, capacity, hash_of)}/index").select("key", "keep_id", "n", "sha", "chain")
    rows = docs.select("doc_id", hash_of(_text()).alias("key"))
    found = spread_join(rows, index.where("chain = 1").drop("chain"), ["key"], "n").drop("key")
    chained = index.where("chain > 1").drop("chain")
    if not chained.isEmpty():
        if not chained.groupBy("key", "sha").count().where("count > 1").isEmpty():
            raise ValueError("two texts have the same key and SHA-256")
        rows = docs.select("doc_id", hash_of(_text()).alias("key"), F.sha2(_text(), 256).alias("sha"))
        rows = rows.join(chained.select("key").distinct(), "key", "left_semi")
        found = found.unionByName(spread_join(rows, chained, ["key", "sha"], "n").drop("key"))
    return found.select("doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def without_copies(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    key = fresh("_key", docs)
    index = docs.sparkSession.read.parquet(f"{build(docs, capacity)}/index").select(F.col("key").alias("_k"), F.col("keep_id").alias("_d"))
    keyed = docs.withColumn(key, F.xxhash64(_text()))
    return keyed.join(index, (keyed[key] == F.col("_k")) & keyed["doc_id"].eqNullSafe(F.col("_d")), "left_semi").drop(key)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(table(spark, sf_dir, "documents"))


QUERIES = {"op13_exact_dedup": op13_exact_dedup}
ORACLE_SQL = {
    "op13_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""
}
