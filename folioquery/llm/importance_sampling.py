"""Target-distribution importance resampling over hashed word n-grams.

A byte automaton reads Arrow's UTF-8 buffers: a table classifies (and lower-cases) each byte, differences of classes are the word borders, and the
CRC-32 registers of all words of a slice advance together, a byte a step; a run of two or three words goes on from the register of the run one
word shorter. Buckets of the corpus and of the target are counted; a bucket's gain is the log ratio of the two, in thousandths; a document's weight is the
sum over its features, and Gumbel noise keyed by doc_id turns the top scores into a weighted sample without replacement.

Scale: the corpus is read twice, to count and to weigh, and its texts are never shuffled. A task of the first pass gives one row for each bucket; gains are
`buckets` numbers, 80 KB, whatever the corpus. Ranks come from a range sort of (doc_id, score): each row's place in its partition and the partitions' sizes, so
no task holds more than its range. Scores are written to the shared folder in between, so a lost executor costs its tasks alone.

Defined results: a null or empty text has no features and weight 0; words may have any length; every row of documents counts, repeated ones too; of equal
scores the smaller doc_id comes first, null before all, and rows equal in both are told apart by nothing; an empty corpus gives no rows, an empty target
leaves the smoothing alone; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .byte_automaton import advanced, advanced_byte
from .common import buffers, checkpointed, slices, table

BUCKETS = 10_000
#: Words of the longest feature.
RUN = 3
MIN_WORDS = 20
PERCENT = 5
SEED = 42
#: What each byte is read as, and 0 for those that part words: digits, letters in lower case, and all bytes beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[48:58], _CLASS[97:123], _CLASS[65:91], _CLASS[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)


@dataclass
class Features:
    bucket: np.ndarray
    text: np.ndarray  # the text that each feature is of
    n_words: np.ndarray  # of each text


def features(texts: pa.Array, run: int = RUN, buckets: int = BUCKETS) -> Features:
    """The bucket of every run of 1 to `run` words of each text."""
    data, at = buffers(texts)
    data = _CLASS[data]
    inside = np.concatenate([[False], data != 0, [False]])
    edge = np.diff(inside.astype(np.int8))
    opens, closes = edge[:-1] == 1, edge[1:] == -1
    border = at[(at > 0) & (at < len(data))]
    opens[border] |= data[border] != 0
    closes[border - 1] |= data[border - 1] != 0
    start = np.flatnonzero(opens)
    long = np.flatnonzero(closes) + 1 - start
    first = np.searchsorted(start, at)
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
    bucket, owner, crc = [], [], np.zeros(len(start), np.uint32)
    for k in range(run):  # crc[i]: of the k words that end before word i
        if k:
            fits = np.flatnonzero(text[k:] == text[: len(text) - k]) + k if len(text) > k else np.zeros(0, np.int64)
            last = np.zeros(len(start), np.uint32)
            last[fits] = advanced(advanced_byte(crc[fits - 1], 32), data, start[fits], long[fits])
        else:
            fits = np.arange(len(start))
            last = advanced(crc, data, start, long)
        crc = last
        bucket.append((last[fits] % np.uint32(buckets)).astype(np.int64))
        owner.append(text[fits])
    return Features(np.concatenate(bucket), np.concatenate(owner), np.diff(first))


def bucket_counts(texts: DataFrame, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all rows of texts(text) in each bucket that has any."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in slices(batches):
            n += np.bincount(features(batch.column("text"), run, buckets).bucket, minlength=buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from two tables (bucket, n)."""
    both = corpus.sparkSession.range(buckets).withColumnRenamed("id", "bucket")
    for df, name in ((corpus, "s"), (target, "t")):
        both = both.join(df.select("bucket", F.col("n").alias(name)), "bucket", "left").fillna(0, [name])
    every = Window.partitionBy(F.lit(0))  # over `buckets` rows, whatever the corpus
    both = both.withColumn("all_s", F.sum("s").over(every)).withColumn("all_t", F.sum("t").over(every))
    up = (F.col("t") + 1).cast("double") * (F.col("all_s") + buckets).cast("double")
    down = (F.col("s") + 1).cast("double") * (F.col("all_t") + buckets).cast("double")
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(up / down)).alias("gain"))


def weights(docs: DataFrame, gain: np.ndarray, run: int = RUN) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each row of docs(doc_id, text)."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = features(batch.column("text"), run, len(gain))
            n = np.bincount(found.text, minlength=batch.num_rows)
            weight = np.bincount(found.text, gain[found.bucket], minlength=batch.num_rows)  # whole numbers far below 2**53
            made = [found.n_words, n, weight.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x.astype(np.int64)) for x in made]], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, the same for the same doc_id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))


def ranked(scored: DataFrame, n: int) -> DataFrame:
    """scored with rank 1, 2, 3... of its n highest scores, ties to the smaller doc_id; null for the others."""
    placed = checkpointed(scored.orderBy(F.desc("score"), "doc_id").withColumn("_at", F.monotonically_increasing_id()))  # partition << 33 | place
    part = F.shiftright("_at", 33)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # over one row for each partition
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    found = placed.withColumn("_part", part).join(F.broadcast(sizes), "_part")
    return found.select(*scored.columns, F.when(rank <= n, rank).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of each row of docs(doc_id, text), drawn to be like target(text)."""
    table = gains(bucket_counts(docs, run, buckets), bucket_counts(target, run, buckets), buckets).collect()  # `buckets` rows
    gain = np.zeros(buckets, np.int64)
    for x in table:
        gain[x["bucket"]] = x["gain"]
    scored = checkpointed(weights(docs, gain, run).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    open_to = scored.where(F.col("n_words") >= min_words).select("doc_id", "n_features", "weight", "score")
    drawn = ranked(open_to, percent * open_to.count() // 100)
    others = scored.where(F.col("n_words") < min_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("bigint").alias("rank"))
    return drawn.unionByName(others)


def op12_importance_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op12_importance_sampling": op12_importance_sampling}
ORACLE_SQL: dict[str, str] = {}
