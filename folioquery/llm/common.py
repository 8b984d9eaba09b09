"""Helpers shared by the training-data operators.

Word hashing is vectorised over whole Arrow buffers, so a task never loops over words in Python. Words are the
maximal runs of bytes other than tab, line feed, vertical tab, form feed, carriage return and space.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task turns into word hashes at once; a longer text is taken alone.
SLICE_BYTES = 1 << 20
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
_NO_LETTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_rng = np.random.default_rng(20240521)
#: 64 random bits for each byte at each of the first places of a word; later places are hashed with the byte.
_PLACES = 64
_BYTE_AT = _rng.integers(0, 2**64, _PLACES * 256, dtype=np.uint64)
_STEP = 0xD6E8FEB86659FD93
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the C library, where it has one


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; a new local one where it is unset on a local master, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder so that its lineage ends; a lost executor costs one task."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def base_path(sf_dir: str, table: str) -> str:
    return f"{sf_dir}/{table}.parquet"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(base_path(sf_dir, name))


def fresh(name: str, df: DataFrame) -> str:
    """A column name like name that df does not have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser; each seed gives another function."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of several texts: a 64-bit hash each, its bytes in data, and the first word of each text."""

    data: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # one longer than the number of texts

    def grams(self, k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words inside one text, and the word at which each starts."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        step, out = np.uint64(_STEP * (2 * seed + 1) & (2**64 - 1)), self.hash[:n].copy()
        for j in range(1, k):
            out = out * step + self.hash[j : j + n]
        left = np.repeat(self.first[1:], np.diff(self.first))[:n]
        at = np.flatnonzero(np.arange(n) + k <= left)
        return mix(out[at], seed), at


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the texts, one after another, and the offset of each; null counts as empty."""
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]], at - at[0]


def words_of(texts: pa.Array, lower: bool = False, letters: bool = False) -> Words:
    """The words of each text, with A-Z as lower case if lower; with letters, ASCII other than letters and digits parts words too."""
    data, at = buffers(texts)
    if lower:
        data = _LOWER[data]
    inside = ~(_NO_LETTER if letters else _SEPARATOR)[data]
    border = np.zeros(len(data) + 1, bool)
    border[at] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | border[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | border[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, at)
    if not len(start):
        return Words(data, np.zeros(0, np.uint64), start, end, first)
    long = end - start
    return Words(data, run_hashes(data[inside], np.cumsum(long) - long, long), start, end, first)


def run_hashes(data: np.ndarray, start: np.ndarray, long: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; the runs tile data.

    A sum of random numbers, one for each byte at its place, so no arrangement of bytes cancels as powers of a base would modulo 2**64.
    """
    short = np.int32 if len(data) < 1 << 23 else np.int64
    at = np.arange(len(data), dtype=short) - np.repeat(start.astype(short), long)
    at <<= 8
    at |= data
    beyond = np.flatnonzero(at >= len(_BYTE_AT)) if long.max() > _PLACES else at[:0]
    later = mix(at[beyond].astype(np.uint64), 7)
    at[beyond] = 0
    values = _BYTE_AT[at]
    values[beyond] = later
    return mix(np.add.reduceat(values, start) + long.astype(np.uint64))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about SLICE_BYTES of text, to bound a task's memory."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // SLICE_BYTES)) + 1
        for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            yield batch.slice(a, b - a)
        del batch
        give_back()


def give_back() -> None:
    """Give memory that Arrow and numpy have freed back to the system, as a worker lives on for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def by_key(df: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch | None], schema: str, order: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """work over the rows of each key, sorted by order, of which there are few enough for a task (see group_plan).

    Unlike a grouped-map function it costs little for a group, so millions of small groups are fine.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [np.asarray(batch.column(k)) for k in keys]
            change = np.zeros(batch.num_rows, bool)
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            change[0] = last is not None and any(c[0] != x for c, x in zip(columns, last, strict=True))
            last = [c[-1] for c in columns]
            cuts = np.flatnonzero(change)
            done = []
            a = 0
            for b in cuts:
                if b > a:
                    held.append(batch.slice(a, b - a))
                if held:
                    done.append(work(pa.Table.from_batches(held)))
                held, a = [], b
            held.append(batch.slice(a))
            yield from _joined(done)
        if held:
            yield from _joined([work(pa.Table.from_batches(held))])

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).select(*names).mapInArrow(run, schema)


def _joined(parts: list[pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    if kept := [p for p in parts if p is not None and p.num_rows]:
        yield from pa.Table.from_batches(kept).combine_chunks().to_batches()


#: Largest keys of a join that are broadcast; no other key has more than this fraction of the rows.
HUBS = 1000


def spread_join(rows: DataFrame, stats: DataFrame, keys: list[str], size: str) -> DataFrame:
    """rows.join(stats, keys), where stats has one row for each key and size says how many rows have it.

    The HUBS largest keys are broadcast; their rows get a random salt that no row of stats has, so a key that a third of all rows have is spread
    over all tasks.
    """
    added = [c for c in stats.columns if c not in keys]
    hub, salt, found = (fresh(name, rows.join(stats.limit(0), keys)) for name in ("_hub", "_salt", "_found"))
    hubs = stats.orderBy(F.desc(size), *keys).limit(HUBS).select(*keys, F.struct(*added).alias(hub))
    salted = rows.join(F.broadcast(hubs), keys, "left").withColumn(salt, F.when(F.col(hub).isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(*rows.columns).bitwiseOR(1)))
    others = stats.select(*keys, F.lit(0).cast("bigint").alias(salt), F.struct(*added).alias(found))
    met = salted.join(others, [*keys, salt], "left").select(*rows.columns, F.coalesce(hub, found).alias(found)).where(F.col(found).isNotNull())
    return met.select(*rows.columns, *[F.col(found)[c].alias(c) for c in added])


def group_plan(rows: DataFrame, keys: list[str], row: Column, limit: int) -> DataFrame:
    """rows with columns _own, _i, _j: every two rows of a key meet in some group (keys, _i, _j), of 2 * limit rows or so.

    A key of up to limit rows is one group. A hotter one is dealt by the hash of row into parts (_own), and each two parts make a group: no
    rows are dropped, and no task holds the whole key. Keys with one row are left out. Give it light rows, and join the heavy columns afterwards.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    out = spread_join(rows, sizes.select(*keys, "_n", F.ceil(F.col("_n") / limit).cast("int").alias("_parts")), keys, "_n")
    own = F.pmod(F.xxhash64(F.lit("part"), row), F.col("_parts")).cast("int")
    out = out.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    return out.select(*rows.columns, "_own", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"))


def roots(linked: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each row of a symmetric boolean matrix."""
    n = len(linked)
    label, order = np.arange(n), np.arange(n)
    while True:
        near = np.where(linked, label[None, :], n).min(1, initial=n)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all() or not n:
            return label[order]
        label = new


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges(a long, b long): component is the smallest id that links lead to.

    Alternates large-star and small-star rounds; each moves at most as many rows as there are edges. An edge is held once, with its larger end as u:
    the least neighbour of a vertex is the least v of the edges that it is the u of, and the edges to its larger neighbours are those that it is the
    v of, so no edge is joined twice. Least neighbours are found with partial minima before the shuffle and given back by spread_join, so a hub among
    the smaller ends is no task of its own; the last join deals edges by their larger ends, as they come. Rounds end when all edges lead to roots,
    which edges that a task has made to a forest often do at once: a round is some ten stages, whose plans and tasks cost the driver memory however
    few the edges are.
    Lineage is cut by a checkpoint in each.
    """
    now = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not _stars(now):
        ends = now.select("v", F.lit(None).cast("bigint").alias("m"), F.lit(1).alias("n")).union(now.select("u", "v", F.lit(0)))
        above = ends.groupBy("v").agg(F.coalesce(F.min("m"), "v").alias("m"), F.sum("n").alias("n")).where("n > 0")
        large = spread_join(now, above, ["v"], "n").select("u", F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v"))
        now = checkpointed(large.join(down, "u").select(moved.alias("u"), F.col("m").alias("v")).distinct())
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _stars(edges: DataFrame) -> bool:
    """Whether every u of the distinct edges(u, v), u > v, has one edge, and its v none to a smaller one: v then is the component of u."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("up")), F.struct(F.col("v").alias("id"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    return ends.groupBy("id").agg(F.max("up").alias("up"), F.count(F.lit(1)).alias("n")).where("up = 1 AND n > 1").isEmpty()
