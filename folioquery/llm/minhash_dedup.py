"""MinHash near-dedup by a signature-coordinate inverted join.

A text's set holds its distinct shingles of five lower-cased words. Texts with equal sets are one class. Each class has a
signature of COORDS minima, that is COORDS (coordinate, value) pairs, and is posted under its prefix: the COORDS - floor + 1 of them that
the fewest classes have. In that common order two classes that agree on at least `floor` coordinates agree within both
prefixes, so none is lost, and pairs that very many classes have are mostly skipped.
Within a posting list the collisions of each two classes are counted coordinate by coordinate, merging the runs of equal values and skipping classes
that can no longer reach the floor; pairs at the floor or above are candidates. `floor` is the largest count that a pair at the threshold
reaches but for a chance of MISS.

Candidates are merged to clusters, so that each class's full set travels once or twice. A cluster of up to PART classes is compared exactly in one
task. A larger one is dealt into parts, each of which is compared with itself and with the cluster's pivot; only classes that are then outside the
cluster's largest verified component meet the rest, part by part. What leaves a task is a spanning forest of its links, never the pairs: a
group of n near copies yields fewer than n rows. Hot posting lists are treated the same way, by signatures.

Scale: signatures of a hundred bytes and 64-bit postings are shuffled, texts once (to find the full sets of classes with a candidate).
Exact copies cost a hash each, as they share a class. n unlike near copies cost n * PART comparisons where they link with each other or
with the pivot; m classes of such a cluster that stay apart cost m * n more, in m * n / PART**2 tasks. Joins on keys that
many rows may have are spread (see spread_join), but for the last one, on the classes of a cluster, which Spark may split.

Defined results: a null text, or one without words, has an empty set, links with nothing and is its own component; fewer than
five words make one shingle; rows with repeated doc_id are judged by their own texts, and one component_id counts for
rows of equal texts; a null doc_id is never a component's name unless no member has another; an empty table gives an
empty table. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, by_key, checkpointed, components, fresh, mix, roots, slices, spread_join, table, words_of

SHINGLE = 5
COORDS = 24
#: Chance that a pair just at the threshold agrees on fewer coordinates than the floor.
MISS = 1e-5
#: Classes of a posting list, and of a cluster's part, that a task compares at once.
LIST = 512
PART = 1024
PART_BYTES = 8 << 20
_rng = np.random.default_rng(77)
_TIMES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _rng.integers(0, 2**63, 256, dtype=np.uint64)


def match_floor(percent: int, coords: int = COORDS, miss: float = MISS) -> int:
    p, below = percent / 100, 0.0
    for k in range(coords + 1):
        below += comb(coords, k) * p**k * (1 - p) ** (coords - k)
        if below > miss:
            return max(k, 1)
    return coords


def shingles(words: Words, k: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    grams, at = words.grams(k)
    place = np.searchsorted(at, words.first)
    out = []
    for i, (a, b) in enumerate(zip(place[:-1], place[1:], strict=True)):
        n = int(words.first[i + 1] - words.first[i])
        if 0 < n < k:
            whole = words.hash[words.first[i] : words.first[i + 1]]
            out.append(Words(words.data, whole, whole, whole, np.array([0, n])).grams(n, seed=n)[0])
        else:
            out.append(np.unique(grams[a:b]))
    return out


def signature(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """Minima, a row for each set; a row of an empty set means nothing."""
    out = np.zeros((len(sets), coords), np.uint32)
    some = [i for i, s in enumerate(sets) if len(s)]
    if some:
        flat = np.concatenate([sets[i] for i in some])
        first = np.cumsum([0, *(len(sets[i]) for i in some[:-1])])
        for c in range(coords):
            out[some, c] = np.minimum.reduceat(((flat * _TIMES[c] + _PLUS[c]) >> np.uint64(32)).astype(np.uint32), first)
    return out


def _digest(s: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(mix(s, 1).sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(s, 2)).view(np.int64)) if len(s) else 0


def features(docs: DataFrame, coords: int = COORDS) -> DataFrame:
    """(doc_id, k, n_shingles, c1, c2, sig): k names the row's doc_id and text by 128 bits, (c1, c2) the set, sig is its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingles(words_of(batch.column("text"), lower=True))
            marks = np.array([_digest(s) for s in sets], np.int64).reshape(-1, 2)
            sig = signature(sets, coords)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("k"), pa.array([len(s) for s in sets], pa.int64()), pa.array(marks[:, 0]), pa.array(marks[:, 1]), pa.array([s.tobytes() for s in sig], pa.binary())],
                ["doc_id", "k", "n_shingles", "c1", "c2", "sig"],
            )

    return _named(docs).mapInArrow(run, "doc_id bigint, k struct<a:bigint,b:bigint>, n_shingles bigint, c1 bigint, c2 bigint, sig binary")


def _name() -> Column:
    row = (F.col("doc_id").cast("bigint"), F.col("text"))
    return F.struct(F.xxhash64(*row).alias("a"), F.xxhash64(F.lit("second"), *row).alias("b"))


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", _name().alias("k"))


def candidate_clusters(classes: DataFrame, percent: int, coords: int = COORDS) -> DataFrame:
    """(id, component): the components of the pairs of classes(cid, sig) that agree on the floor or more.

    Lists of up to LIST classes are compared in one task each. In a longer list every class is first compared with the list's
    pivot, its least class; classes that are then connected, through any lists, are skipped, and only those outside the
    list's largest component meet the others, part by part. What is skipped is connected already, so nothing is lost.
    """
    floor = match_floor(percent, coords)
    hexed = F.hex("sig")
    value = lambda j: F.substring(hexed, F.lit(8 * j + 1), F.lit(8))
    every = classes.select("cid", F.explode(F.array(*[F.xxhash64(F.lit(j), value(j)) for j in range(coords)])).alias("post"))
    counts = every.groupBy("post").agg(F.count(F.lit(1)).alias("held"))
    rarest = spread_join(every, counts, ["post"], "held").groupBy("cid").agg(F.slice(F.array_sort(F.collect_list(F.struct("held", "post"))), 1, coords - floor + 1).alias("prefix"))
    posts = rarest.select("cid", F.explode(F.filter("prefix", lambda x: x["held"] > 1)).alias("it")).select("cid", "it.post")
    lists = posts.groupBy("post").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("pivot")).where("n > 1")
    posts = checkpointed(spread_join(posts, lists, ["post"], "n"))
    sig = classes.select("cid", "sig")

    def work(group: pa.Table) -> pa.RecordBatch | None:
        cid = np.asarray(group["cid"])
        rows = np.frombuffer(b"".join(group["sig"].to_pylist()), np.uint32).reshape(len(cid), coords)
        if len(cid) <= 32:
            return forest(cid, (rows[:, None] == rows[None]).sum(2) >= floor)
        at, same = collisions(rows, floor)
        return forest(cid[at], same >= floor)

    def with_pivot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, coords) for c in ("sig", "pivot_sig"))
            near = pa.array((own == other).sum(1) >= floor)
            yield pa.RecordBatch.from_arrays([batch.column("cid").filter(near), batch.column("pivot").filter(near)], ["a", "b"])

    kind = "a bigint, b bigint"
    short = by_key(posts.where(F.col("n") <= LIST).join(sig, "cid").select("post", "cid", "sig"), ["post"], work, kind)
    long = posts.where(F.col("n") > LIST)
    pairs = long.where("cid <> pivot").select("cid", "pivot").distinct().join(sig, "cid").join(sig.select(F.col("cid").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot")
    edges = checkpointed(short.unionByName(pairs.select("cid", "pivot", "sig", "pivot_sig").mapInArrow(with_pivot, kind)))
    clusters = components(edges)
    label = clusters.select(F.col("id").alias("cid"), F.col("component").alias("label"))
    long = long.select("post", "cid", "n").join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    largest = long.groupBy("post", "label").count().groupBy("post").agg(F.max_by("label", F.struct("count", "label")).alias("largest"), F.sum("count").alias("n"), F.max("count").alias("most"))
    largest = largest.where("most < n").select("post", "largest", "n", F.ceil(F.col("n") / LIST).cast("int").alias("parts"), F.ceil((F.col("n") - F.col("most")) / LIST).cast("int").alias("outer"))
    largest = checkpointed(largest)
    if largest.isEmpty():
        return clusters
    rest = spread_join(long.select("post", "cid", "label"), largest, ["post"], "n")
    part = F.xxhash64(F.lit("part"), "cid")
    inner = rest.select("post", "cid", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("_i"), F.pmod(part, F.col("parts")).cast("int").alias("_j"))
    outer = rest.where("label <> largest").select("post", "cid", F.pmod(part, F.col("outer")).cast("int").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_j"))
    met = inner.unionByName(outer).distinct().join(sig, "cid").select("post", "_i", "_j", "cid", "sig")
    return components(clusters.toDF("a", "b").unionByName(by_key(met, ["post", "_i", "_j"], work, kind)))


def collisions(rows: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows that may have floor equal coordinates with another one, and how many each two of them have."""
    at, coords = np.arange(len(rows)), rows.shape[1]
    same = np.zeros((len(rows), len(rows)), np.uint8)
    for c in range(coords):
        value, run, size = np.unique(rows[at, c], return_inverse=True, return_counts=True)
        if len(value) < len(at):
            some = np.flatnonzero(size[run] > 1)  # a value that one class has collides with none
            cells = (slice(None), slice(None)) if len(some) == len(at) else np.ix_(some, some)
            same[cells] += run[some, None] == run[None, some]
        if c % 6 == 5 and c + 1 < coords:
            best = same - np.diag(np.diagonal(same))
            near = best.max(1, initial=0) + coords - c - 1 >= floor
            if not near.all():
                at, same = at[near], same[np.ix_(near, near)]
    return at, same


def forest(ids: np.ndarray, linked: np.ndarray) -> pa.RecordBatch | None:
    root = ids[roots(linked)]
    far = np.flatnonzero(root != ids)
    return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(root[far])], ["a", "b"]) if len(far) else None


def confirmed_clusters(docs: DataFrame, classes: DataFrame, clusters: DataFrame, percent: int) -> DataFrame:
    """(id, component): the components of the pairs within clusters(cid, cluster) whose full sets reach the threshold."""
    inside = classes.join(clusters, "cid").select("cid", "k", "n_shingles", "cluster")
    sizes = inside.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight"), F.min(F.struct("cid", "k")).alias("pivot")).where("n > 1")
    parts = lambda n: F.greatest(F.ceil(n / PART), F.ceil(F.col("weight") * 8 / PART_BYTES * n / F.col("n")), F.lit(1)).cast("int")
    members = checkpointed(spread_join(inside.select("cid", "k", "cluster"), sizes.withColumn("parts", parts(F.col("n"))), ["cluster"], "n"))
    part = F.xxhash64(F.lit("part"), "cid")
    own = members.select("cid", "k", "cluster", F.pmod(part, F.col("parts")).cast("int").alias("_i"))
    pivots = members.where("parts > 1 AND cid = pivot.cid").select("cid", "k", "cluster", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_i"))
    groups = own.unionByName(pivots).distinct().withColumn("_j", F.col("_i"))
    linked = components(_linked(docs, groups, percent))
    label = linked.select(F.col("id").alias("cid"), F.col("component").alias("label"))
    big = members.where("parts > 1").select("cid", "k", "cluster", "n", "weight", "parts").join(label, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    largest = big.groupBy("cluster", "label").count().groupBy("cluster").agg(F.max_by("label", F.struct("count", "label")).alias("largest"), F.sum("count").alias("all"), F.max("count").alias("most"))
    largest = checkpointed(largest.where(F.col("most") < F.col("all")))
    if largest.isEmpty():
        return linked
    rest = spread_join(big, largest, ["cluster"], "all").withColumn("outer", parts(F.col("all") - F.col("most")))
    inner = rest.select("cid", "k", "cluster", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("_i"), F.pmod(part, F.col("parts")).cast("int").alias("_j"))
    outer = rest.where("label <> largest").select("cid", "k", "cluster", F.pmod(part, F.col("outer")).cast("int").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("_j"))
    return components(linked.toDF("a", "b").unionByName(_linked(docs, inner.unionByName(outer).distinct(), percent)))


def _linked(docs: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """(a, b): a spanning forest of the pairs within each group of groups(cid, k, cluster, _i, _j) whose full sets reach the threshold."""
    kind = "array<struct<cluster:bigint,_i:int,_j:int>>"
    plan = groups.groupBy("cid", "k").agg(F.collect_list(F.struct("cluster", "_i", "_j")).cast(kind).alias("groups"))
    texts = _named(docs).select("k", "text").join(plan, "k")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = shingles(words_of(batch.column("text"), lower=True))
            yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("groups"), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "groups", "set"])

    rows = texts.select("cid", "groups", "text").mapInArrow(sets_of, f"cid bigint, groups {kind}, set binary").select("cid", "set", F.inline("groups"))

    def work(group: pa.Table) -> pa.RecordBatch | None:
        cid, first = np.unique(np.asarray(group["cid"]), return_index=True)
        sets = [np.frombuffer(s.as_py(), np.uint64) for s in group["set"].take(pa.array(first))]
        size = np.array([len(s) for s in sets])
        common = intersections(sets)
        return forest(cid, 100 * common >= percent * (size[:, None] + size[None] - common))

    return by_key(rows.select("cluster", "_i", "_j", "cid", "set"), ["cluster", "_i", "_j"], work, "a bigint, b bigint")


def intersections(sets: list[np.ndarray], cells: int = 1 << 22) -> np.ndarray:
    """Sizes of all intersections, by products of bounded blocks of the incidence matrix."""
    n = len(sets)
    flat, row = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    out = np.diag([len(s) for s in sets]).astype(np.int64)
    keep = count[column] > 1
    if not keep.any():
        return out
    row, shared = row[keep], np.cumsum(count > 1) - 1
    column = shared[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(1, cells // n)
    total = np.zeros((n, n))
    for a in range(0, int(column[-1]) + 1, width):
        lo, hi = np.searchsorted(column, [a, a + width])
        block = np.zeros((n, width), np.float32)
        block[row[lo:hi], column[lo:hi] - a] = 1
        total += block @ block.T
    np.fill_diagonal(total, 0)
    return out + np.rint(total).astype(np.int64)


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs(doc_id, text) as (doc_id, k, n_shingles, component_id, kept); links are pairs with 100 * intersection >= percent * union."""
    rows = checkpointed(features(docs))
    classes = rows.where("n_shingles > 0").groupBy("c1", "c2").agg(F.min("doc_id").alias("least"), F.min("k").alias("k"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    classes = checkpointed(classes.withColumn("cid", F.monotonically_increasing_id()))
    clusters = candidate_clusters(classes, percent).select(F.col("id").alias("cid"), F.col("component").alias("cluster"))
    linked = confirmed_clusters(docs, classes, clusters, percent).select(F.col("id").alias("cid"), F.col("component").alias("root"))
    named = classes.select("cid", "c1", "c2", "least").join(linked, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("c1", "c2", "component_id", F.lit(True).alias("_some"))
    out = rows.select("doc_id", "k", "n_shingles", "c1", "c2", (F.col("n_shingles") > 0).alias("_some")).join(named, ["c1", "c2", "_some"], "left")
    out = out.select("doc_id", "k", "n_shingles", F.when(F.col("_some"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns, that near_duplicates keeps: of each group the rows with its least doc_id.

    Rows to drop are named by 128 bits of hashes of doc_id and text, so no row goes because its name equals another's by chance.
    """
    name = fresh("key", docs)
    drop = near_duplicates(docs, percent).where("not kept").select(F.col("k").alias(name)).distinct()
    return docs.withColumn(name, _name()).join(drop, name, "left_anti").select(docs.columns)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), 85).drop("k")


QUERIES = {"op9_minhash_dedup": op9_minhash_dedup}
ORACLE_SQL: dict[str, str] = {}
