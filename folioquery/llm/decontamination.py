"""Benchmark decontamination by SimHash windows.

For every benchmark item a window of the item's length slides over each document. A window's fingerprint is the 64-bit SimHash of its
words. Items are posted under BLOCKS blocks of their fingerprints, each as it is and with one bit turned, windows under each block of
their own; an equi-join on (length, block, value) finds every item within RADIUS = 2 * BLOCKS - 1 bits, as 2 * BLOCKS - 1 differing bits leave some
block with one at most. What is found within the radius is verified exactly: multisets of five-word shingles, weighted by how
often they occur, with sum of least over sum of greatest counts >= threshold.

Windows that cannot reach the threshold are not fingerprinted: two multisets of a and b shingles reach t only with
t / (1 + t) * (a + b) shingles in common, so a window needs that many shingles that occur in items of its length. A filter of
at most FILTER_BITS bits, built by the tasks, says which do; it may say yes by chance, which costs time, but never no.

Words are lower-cased runs of letters, digits and bytes outside ASCII, so punctuation at a passage's ends does not matter.

Scale: one pass over whole texts; only windows that may match are shuffled, and those of equal words are fingerprinted, joined and verified once. What is
broadcast is the filter, whose size is bounded, and lists whose size is checked; the benchmark may be of any size.

Defined results: null and empty texts, and items without words, match nothing; an item of fewer than five words is one
shingle of all its words; a document shorter than the item is one window; of several windows of a document and item
the most similar counts, the first of equal ones; items with equal words each count; repeated rows of docs give a row
each; null ids are kept; an empty table gives an empty table. Only doc_id, item_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, by_key, checkpointed, fresh, mix, slices, spread_join, table, words_of

SHINGLE = 5
BLOCKS = 10
RADIUS = 2 * BLOCKS - 1
#: Most bits of the filter of known shingles (32 MB), and bits for each shingle below that.
FILTER_BITS, SHINGLE_BITS = 1 << 28, 64
#: Rows of a list of hashes up to which it is broadcast.
LISTED = 200_000
_CUTS = np.linspace(0, 64, BLOCKS + 1).astype(int).tolist()
_CHUNK = 1 << 16


def simhash(hashes: np.ndarray) -> np.ndarray:
    """Fingerprints of equally long runs of word hashes, a row each; a tie of votes gives a zero bit."""
    rows, long = hashes.shape
    votes = np.zeros((rows, 64), np.int32)
    for j in range(long):
        votes += np.unpackbits(mix(hashes[:, j], 9).astype("<u8").view(np.uint8).reshape(rows, 8), axis=1, bitorder="little")
    return np.packbits(2 * votes > long, axis=1, bitorder="little").view("<u8").ravel()


def shingles_of(hashes: np.ndarray) -> np.ndarray:
    """Shingle hashes of one run of words, in order."""
    words = Words(np.zeros(0, np.uint8), hashes, hashes, hashes, np.array([0, len(hashes)]))
    return words.grams(min(SHINGLE, len(hashes)), seed=0)[0]


def weighted_similarity(a: np.ndarray, b: np.ndarray) -> float:
    x, y = Counter(a.tolist()), Counter(b.tolist())
    common = (x & y).total()
    return common / (len(a) + len(b) - common)


def _contents(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that name each run of words, a row each."""
    place = np.arange(runs.shape[1], dtype=np.uint64)
    return tuple(mix(runs + mix(place, seed), seed).sum(1, dtype=np.uint64).view(np.int64) for seed in (21, 22))


def _of_length(shingles: np.ndarray, n: int) -> np.ndarray:
    return shingles ^ mix(np.array([n], np.uint64), 31)


_RUN = [pa.field("c1", pa.int64()), pa.field("c2", pa.int64()), pa.field("print", pa.int64()), pa.field("shingles", pa.binary())]
_RUN_SQL = "c1 bigint, c2 bigint, print bigint, shingles binary"


def _run_columns(runs: np.ndarray) -> list[pa.Array]:
    one, two = _contents(runs)
    return [pa.array(one), pa.array(two), pa.array(simhash(runs).view(np.int64)), pa.array([shingles_of(r).tobytes() for r in runs], pa.binary())]


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, n, c1, c2, print, shingles) of each item with words: a number of its own, its length, and what its words give."""
    kind = benchmark.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = words_of(batch.column("text"), lower=True, letters=True)
            sizes = np.diff(words.first)
            for n in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == n)
                runs = words.hash[words.first[at][:, None] + np.arange(n)]
                ids = [batch.column(c).take(pa.array(at)) for c in ("item", "item_id")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(np.full(len(at), n, np.int32)), *_run_columns(runs)], ["item", "item_id", "n", *(f.name for f in _RUN)])

    numbered = benchmark.select(F.monotonically_increasing_id().alias("item"), "item_id", "text")
    return checkpointed(numbered.mapInArrow(run, f"item bigint, item_id {kind}, n int, {_RUN_SQL}"))


class Filter:
    """Which shingles occur in items, and which in items of a length."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.bits = cells, len(cells) * 8

    @staticmethod
    def places(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        two = mix(values, 41)
        return (values & np.uint64(bits - 1)).astype(np.int64), (two & np.uint64(bits - 1)).astype(np.int64)

    def has(self, values: np.ndarray) -> np.ndarray:
        one, two = self.places(values, self.bits)
        found = np.flatnonzero(self.cells[one >> 3] >> (one & 7).astype(np.uint8) & 1)
        found = found[(self.cells[two[found] >> 3] >> (two[found] & 7).astype(np.uint8) & 1) > 0]
        out = np.zeros(len(values), bool)
        out[found] = True
        return out


def filter_of(contents: DataFrame, most: int = FILTER_BITS) -> Filter:
    """The filter of contents(n, shingles): each task sets bits of some chunks; the driver gets the chunks, most / 8 bytes at most."""
    total = contents.agg(F.coalesce(F.sum(F.octet_length("shingles") / 8), F.lit(0))).first()[0]
    bits = min(most, max(_CHUNK, 1 << int(total * SHINGLE_BITS).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, raw in zip(batch.column("n").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                shingles = np.unique(np.frombuffer(raw, np.uint64))
                own = _of_length(shingles, n)
                at = np.unique(np.concatenate([p for v in ((shingles, own) if n >= SHINGLE else (own,)) for p in Filter.places(v, bits)]))
                yield pa.RecordBatch.from_arrays([pa.array((at // _CHUNK).astype(np.int32)), pa.array((at % _CHUNK).astype(np.int32))], ["chunk", "bit"])

    def packed(group: pa.Table) -> pa.RecordBatch:
        cells = np.zeros(_CHUNK, bool)
        cells[np.asarray(group["bit"])] = True
        return pa.RecordBatch.from_arrays([group["chunk"].combine_chunks()[:1], pa.array([np.packbits(cells, bitorder="little").tobytes()], pa.binary())], ["chunk", "cells"])

    cells = np.zeros(bits // 8, np.uint8)
    set_bits = contents.select("n", "shingles").mapInArrow(places, "chunk int, bit int").distinct()
    for row in by_key(set_bits, ["chunk"], packed, "chunk int, cells binary").toLocalIterator():
        cells[row["chunk"] * _CHUNK // 8 :][: _CHUNK // 8] = np.frombuffer(row["cells"], np.uint8)
    return Filter(cells)


#: Words of the windows that a task looks at together.
CELLS = 1 << 19


def windows(words: Words, known: Filter, lengths: list[int], threshold: float) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(item length, words of a window, first words, texts) of the windows that may reach the threshold with some item of that length."""
    grams, at = words.grams(SHINGLE)
    found = known.has(grams)
    hit, marked, sizes = at[found], grams[found], np.diff(words.first)
    doc = np.searchsorted(words.first, hit, side="right") - 1
    for n in lengths:
        if n < SHINGLE:
            small, small_at = words.grams(n)
            starts = small_at[known.has(_of_length(small, n))]
            yield n, n, starts, np.searchsorted(words.first, starts, side="right") - 1
            continue
        inside = known.has(_of_length(marked, n)) if len(marked) else np.zeros(0, bool)
        places, texts = hit[inside], doc[inside]
        if not len(places):
            continue
        full = n - SHINGLE + 1
        fit = sizes[texts] >= n
        # a window starts at s and has its shingles at s .. s + full - 1
        last = places[fit]
        begin = np.maximum(last - full + 1, np.concatenate([[0], last[:-1] + 1])) if len(last) else last  # what the place before has not covered
        many = last - begin + 1
        spread = np.repeat(begin - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
        owner = np.searchsorted(words.first, spread, side="right") - 1
        ok = spread + n <= words.first[owner + 1]
        spread, owner = spread[ok], owner[ok]
        count = np.searchsorted(places, spread + full) - np.searchsorted(places, spread)
        enough = count >= threshold / (1 + threshold) * 2 * full - 1e-9
        yield n, n, spread[enough], owner[enough]
        short, have = np.unique(texts[~fit], return_counts=True)  # a shorter text is one window
        for t, m in zip(short.tolist(), have.tolist(), strict=True):
            own = int(sizes[t])
            if m >= threshold / (1 + threshold) * (full + own - SHINGLE + 1) - 1e-9:
                yield n, own, words.first[t : t + 1], np.array([t])


def _name(text: Column) -> Column:
    """128 bits that name a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b"))


def candidate_windows(docs: DataFrame, known: Filter, lengths: list[int], threshold: float) -> DataFrame:
    """(t, start, n_words, n, c1, c2, print, shingles): t names the text; each distinct text of a slice is read once."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names = np.stack([np.asarray(batch.column("t").field(i)) for i in (0, 1)], 1)
            batch = batch.take(pa.array(np.unique(names, axis=0, return_index=True)[1]))
            words = words_of(batch.column("text"), lower=True, letters=True)
            for n, long, starts, owner in windows(words, held.value, lengths, threshold):
                some = max(1, CELLS // long)
                for a in range(0, len(starts), some):
                    s, texts = starts[a : a + some], owner[a : a + some]
                    sizes = [np.full(len(s), x, np.int32) for x in (long, n)]
                    columns = [batch.column("t").take(pa.array(texts)), pa.array((s - words.first[texts]).astype(np.int32)), *map(pa.array, sizes), *_run_columns(words.hash[s[:, None] + np.arange(long)])]
                    yield pa.RecordBatch.from_arrays(columns, ["t", "start", "n_words", "n", *(f.name for f in _RUN)])

    source = docs.where("text is not null").select(_name(F.col("text")).alias("t"), "text")
    return source.mapInArrow(run, f"t struct<a:bigint,b:bigint>, start int, n_words int, n int, {_RUN_SQL}")


def _posts(turned: bool) -> Column:
    """The (block, value) pairs of a fingerprint, with each bit turned once if asked for."""
    out = []
    for b in range(BLOCKS):
        width = _CUTS[b + 1] - _CUTS[b]
        value = F.shiftrightunsigned("print", _CUTS[b]).bitwiseAND((1 << width) - 1)
        for bit in [0, *(1 << i for i in range(width))] if turned else [0]:
            out.append(F.struct(F.lit(b).alias("block"), value.bitwiseXOR(bit).cast("int").alias("value")))
    return F.inline(F.array(*out))


def verified(found: DataFrame, items: DataFrame, threshold: float) -> DataFrame:
    """(n, c1, c2, i1, i2, similarity) of the distinct windows (n, c1, c2, print, shingles) and item contents (i1, i2) that reach the threshold."""
    contents = items.dropDuplicates(["c1", "c2"]).select("n", F.col("c1").alias("i1"), F.col("c2").alias("i2"), "print", F.col("shingles").alias("item_shingles"))
    one = found.select("n", "c1", "c2", F.col("print").alias("own"), _posts(False))
    two = contents.select("n", "i1", "i2", F.col("print").alias("other"), _posts(True))
    near = one.join(two, ["n", "block", "value"]).where(F.bit_count(F.col("own").bitwiseXOR(F.col("other"))) <= RADIUS)
    near = near.select("n", "c1", "c2", "i1", "i2").distinct().join(found.select("n", "c1", "c2", "shingles"), ["n", "c1", "c2"]).join(contents.select("i1", "i2", "item_shingles"), ["i1", "i2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("shingles").to_pylist(), batch.column("item_shingles").to_pylist(), strict=True)
            similar = np.array([weighted_similarity(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)) for a, b in pairs])
            kept = pa.array(similar >= threshold - 1e-12, pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).filter(kept) for c in ("n", "c1", "c2", "i1", "i2")), pa.array(similar, pa.float64()).filter(kept)], ["n", "c1", "c2", "i1", "i2", "similarity"])

    return near.select("n", "c1", "c2", "i1", "i2", "shingles", "item_shingles").mapInArrow(run, "n int, c1 bigint, c2 bigint, i1 bigint, i2 bigint, similarity double")


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(t, held, found): what each distinct text of docs that matches some item matches, as array<struct<item_id,start,n_words,similarity>>."""
    items = items_of(benchmark)
    lengths = sorted(r["n"] for r in items.select("n").distinct().toLocalIterator())
    rows = checkpointed(candidate_windows(docs, filter_of(items.dropDuplicates(["c1", "c2"])), lengths, threshold))
    key = ["n", "c1", "c2"]
    found = rows.groupBy(*key).agg(F.first("print").alias("print"), F.first("shingles").alias("shingles"), F.count(F.lit(1)).alias("held"))
    pairs = verified(found, items, threshold).join(items.select("item", "item_id", F.col("c1").alias("i1"), F.col("c2").alias("i2")), ["i1", "i2"])
    pairs = pairs.groupBy(*key).agg(F.collect_list(F.struct("item", "item_id", "similarity")).alias("pairs")).join(found.select(*key, "held"), key)
    met = spread_join(rows.select("t", "start", "n_words", *key), pairs, key, "held").select("t", "start", "n_words", F.inline("pairs"))
    best = met.groupBy("t", "item").agg(F.first("item_id").alias("item_id"), F.min(F.struct((-F.col("similarity")).alias("far"), "start", "n_words")).alias("best"))
    one = F.struct("item_id", F.col("best.start").alias("start"), F.col("best.n_words").alias("n_words"), (-F.col("best.far")).alias("similarity"))
    return best.groupBy("t").agg(F.collect_list(one).alias("found"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, start, n_words, similarity) for docs(doc_id, text) and benchmark(item_id, text)."""
    rows = docs.where("text is not null").select("doc_id", _name(F.col("text")).alias("t"))
    found = checkpointed(matches(docs, benchmark, threshold))
    few = found.limit(LISTED + 1).count() <= LISTED
    named = rows.join(F.broadcast(found.select("t")) if few else found.select("t"), "t", "left_semi")
    held = named.groupBy("t").agg(F.count(F.lit(1)).alias("rows"))
    return spread_join(named, found.join(held, "t"), ["t"], "rows").select("doc_id", F.inline("found"))


def uncontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, that match no item. Where the list of texts that do is small it is broadcast, and no text is shuffled."""
    name = fresh("text_name", docs)
    bad = checkpointed(matches(docs, benchmark, threshold).select(F.col("t").alias(name)))
    few = bad.limit(LISTED + 1).count() <= LISTED
    return docs.withColumn(name, _name(F.col("text"))).join(F.broadcast(bad) if few else bad, name, "left_anti").select(docs.columns)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op4_decontamination": op4_decontamination}
ORACLE_SQL: dict[str, str] = {}
