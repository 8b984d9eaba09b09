"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text: its distinct words and their beginnings, word pairs, word triples, and pairs that skip one or two words, each hashed to one
of 2**BITS coordinates. Every coordinate has its own learning rate, and L1 keeps most weights at exactly zero, so the model
is a short list of (coordinate, weight), at most 2**BITS of them, which travels to the tasks.

Training is bounded: at most SAMPLE labelled rows, those of least hash. They are dealt over SHARDS; in each of ROUNDS rounds every shard
starts from the common state (z, n), learns from its rows in an order fixed by the hash, each counted SHARDS times as if it
were the whole sample, and the changes of z and n are averaged coordinate by coordinate. Tasks add up the changes of all shards, CHUNK
coordinates each, so the driver gets eight bytes a coordinate in a round, however many shards there are. Scoring is one pass over whole texts with no shuffle.

Defined results: null and empty texts have no features and score by the bias alone; rows with null or repeated doc_id keep a row each;
labels that are null, or whose document has no row, teach nothing, and a document with several labels counts with each; with
no labels, or of one kind only, the score is the smoothed rate of label 1 (0.25 with none); an empty table gives an empty table.
Only doc_id, text and the label are read; other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, by_key, checkpointed, give_back, mix, slices, table, words_of

BITS = 20
#: Bytes of a word's beginnings, which stand for its inflected forms.
STEMS = (4, 5, 6)
SAMPLE = 24_000
SHARDS = 6
ROUNDS = 4
#: Coordinates whose changes are a row.
CHUNK = 1 << 15
#: L1 is the best of 6 to 20 on a fifth of the training rows (area under the curve 0.989; 0.981 at 6, which kept four times the weights).
ALPHA, BETA, L1, L2 = 0.3, 1.0, 10.0, 0.1


def features(words: Words, bits: int = BITS, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct coordinates of each text, one text after another, and the first place of each text.

    With weight, coordinates whose weight is zero are left out.
    """
    h, n = words.hash, len(words.hash)
    left = np.repeat(words.first[1:], np.diff(words.first)) - np.arange(n)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    made, docs = [h], [doc]
    for k in STEMS:
        at = np.flatnonzero(words.end - words.start >= k)
        stem = np.full(len(at), np.uint64(k))
        for j in range(k):
            stem = (stem ^ (stem >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) + words.data[words.start[at] + j]
        made.append(stem)
        docs.append(doc[at])
    for salt, gaps in ((3, (1,)), (5, (1, 2)), (7, (2,)), (11, (3,))):  # pairs, triples, pairs that skip one or two words
        reach = gaps[-1]
        if n > reach:
            at = np.flatnonzero(left[: n - reach] > reach)
            value = h[at] * np.uint64(salt)
            for g in gaps:
                value = (value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[at + g]
            made.append(value)
            docs.append(doc[at])
    cell = mix(np.concatenate(made)) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - bits)
    both = np.concatenate(docs).astype(np.uint64) << np.uint64(bits) | cell
    both = np.unique(both if weight is None else both[weight[cell] != 0])
    first = np.searchsorted(both, np.arange(len(words.first), dtype=np.uint64) << np.uint64(bits))
    return (both & np.uint64((1 << bits) - 1)).astype(np.int64), first


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def _learn(state: tuple[np.ndarray, np.ndarray], texts: pa.Array, labels: np.ndarray, prior: float, bits: int, times: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """z and n after one pass over the texts, each of which counts so many times."""
    z, n = state[0].copy(), state[1].copy()
    for a in range(0, len(labels), 256):
        cells, first = features(words_of(texts[a : a + 256], lower=True), bits)
        for i, y in enumerate(labels[a : a + 256]):
            c = cells[first[i] : first[i + 1]]
            w = _weights(z[c], n[c])
            g = 1 / (1 + np.exp(-np.clip(prior + w.sum(), -30, 30))) - y
            root = np.sqrt(n[c])
            n[c] += times * g * g
            z[c] += times * g - (np.sqrt(n[c]) - root) / ALPHA * w
    return z, n


def _learner(held: Broadcast, prior: float, bits: int, shards: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a shard does in a round: start from the common state, learn from its rows, give the changes."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z0, n0 = (x.astype(float) for x in held.value)
        z, n = z0, n0
        for batch in slices(batches):
            z, n = _learn((z, n), batch.column("text"), np.asarray(batch.column("label")), prior, bits, shards)
        with np.errstate(over="ignore"):
            moved = [((a - b) / shards).astype(np.float16) for a, b in ((z, z0), (n, n0))]
        if not all(np.isfinite(x).all() for x in moved):
            raise ValueError("a shard has more rows than half-precision sums hold: take more shards")
        chunks = range(0, len(z), CHUNK)
        parts = [pa.array([x[a : a + CHUNK].tobytes() for a in chunks], pa.binary()) for x in moved]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), *parts], ["chunk", "dz", "dn"])

    return learn


def _added(changes: pa.Table) -> pa.RecordBatch:
    """One row for the rows of a chunk: the sums of their half-precision numbers, in single precision."""
    sums = [np.sum([np.frombuffer(x, np.float16) for x in changes[c].to_pylist()], axis=0, dtype=float).astype(np.float32) for c in ("dz", "dn")]
    return pa.RecordBatch.from_arrays([changes["chunk"].combine_chunks()[:1], *(pa.array([x.tobytes()], pa.binary()) for x in sums)], ["chunk", "dz", "dn"])


_CHANGES = "chunk int, dz binary, dn binary"


def train(labelled: DataFrame, sample: int = SAMPLE, shards: int = SHARDS, rounds: int = ROUNDS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, float]:
    """(coordinates, weights, bias) from labelled(doc_id, text, label 0 or 1); at most sample rows are used."""
    order = F.xxhash64(F.lit("order"), "doc_id", "text", "label")
    rows = labelled.where("label in (0, 1)").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"), order.alias("turn"))
    seen, ones = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    rate = ((ones or 0) + 0.5) / (seen + 2)
    prior = float(np.log(rate / (1 - rate)))
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    if not seen or ones in (0, seen):
        return np.zeros(0, np.int64), np.zeros(0), prior
    if seen > sample:
        rows = rows.orderBy("turn").limit(sample)
    rows = checkpointed(rows.repartition(shards).sortWithinPartitions("turn"))  # a shard is a partition
    for _ in range(rounds):
        held = labelled.sparkSession.sparkContext.broadcast((z.astype(np.float32), n.astype(np.float32)))
        changes = rows.mapInArrow(_learner(held, prior, bits, shards), _CHANGES)
        for moved in by_key(changes, ["chunk"], _added, _CHANGES).collect():  # 8 MB
            at = slice(moved["chunk"] * CHUNK, (moved["chunk"] + 1) * CHUNK)
            z[at] += np.frombuffer(moved["dz"], np.float32)
            n[at] += np.frombuffer(moved["dn"], np.float32)
        held.destroy()  # the driver's copy too
    w = _weights(z, n)
    at = np.flatnonzero(w)
    model = at, w[at], prior
    del z, n, w
    give_back()  # the driver has far less to hold from here on
    return model


def _scores(held, bits: int) -> Callable[[pa.Array], np.ndarray]:
    at, weight, prior = held.value
    w = np.zeros(1 << bits)
    w[at] = weight

    def scores(texts: pa.Array) -> np.ndarray:
        cells, first = features(words_of(texts, lower=True), bits, w)
        total = np.concatenate([[0.0], np.cumsum(w[cells])])
        return 1 / (1 + np.exp(-np.clip(prior + total[first[1:]] - total[first[:-1]], -30, 30)))

    return scores


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> DataFrame:
    """docs(doc_id, text) as (doc_id, score, predicted)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores(held, bits)
        for batch in slices(batches):
            value = scores(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value), pa.array((value >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def without_toxic(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], bits: int = BITS) -> DataFrame:
    """The rows of docs, all columns, whose text scores below 0.5."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores(held, bits)
        for batch in slices(batches):
            yield batch.filter(pa.array(scores(batch.column("text")) < 0.5))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def model_for(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[np.ndarray, np.ndarray, float]:
    """A model of the labels whose rows are not held out: of the SAMPLE labels of least hash, so the join broadcasts no more."""
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").alias("label"))
    labels = labels.where("label is not null").orderBy(F.xxhash64("doc_id", "label")).limit(SAMPLE)
    return train(docs.select("doc_id", "text").join(F.broadcast(labels), "doc_id"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, model_for(spark, docs, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE_SQL: dict[str, str] = {}
