"""Embedding near-dedup by iterative quantisation.

Codes: unit vectors are centred and turned to their principal axes, and a rotation is learned, by alternating signs and the best
orthogonal fit, that brings them close to the corners of a cube; the signs are balanced bits. TRAIN vectors, those of least
hash, teach it. A code has at most CODE bits. Blocks of bits are the keys of tables: side by side where the code is long enough for all, else drawn from it anew for each
table. Two vectors meet where some block is equal, by their codes alone, and of those that meet only
pairs within `radius` bits of each other over the whole code go on. Block width follows the number of vectors, so that a block value
holds some BUCKET of them, and the number of tables follows from the width: a pair just at the threshold meets in some table but for a chance
of MISS (bits of such a pair differ with chance angle / pi), and lies within the radius but for a few in ten thousand.
Vectors with such a partner are fetched, once for each table that has one, and reranked by the cosine of the original vectors in double
precision, so no link is below the threshold.

Equal vectors are one class with a weight. A pair that meets in several tables counts in the first alone. What leaves a task is a row for each
vector (whether it has a partner; then its links there, and the least class they lead to), never the pairs. A hot block value is dealt into parts,
each two parts to a task (see group_plan).

Scale: what is shuffled for each table is a block value, an id and a code of at most 32 bytes, whatever the number of vectors (11 bytes for 50,000); the number of tables
grows as n**0.22 at 0.9 (11 for 50,000 vectors, 200 or so for 10**10). Copies of one vector, and vectors that link with nothing, are no key of their own in the last join. Comparisons of codes are some BUCKET for each vector and table. Links inside a cluster of n unlike vectors need its n * n / 2
comparisons, as each is to be counted.

Defined results: a vector that is null, empty, zero, or has null or non-finite components has no links and is its own component;
vectors of unlike length are never linked; rows with null or repeated vec_id keep a row each, and n_links counts the other
rows; a null vec_id is no component's name unless no member has another; an empty table gives an empty table. Only
vec_id and embedding are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, comb, log, log2, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, checkpointed, components, group_plan, roots, spread_join, table

TRAIN = 20_000
BUCKET = 256
MISS = 0.03
#: Bits of a code, at most.
CODE = 256
PART = 512
ROUNDS = 30


def radius(bits: int, threshold: float) -> int:
    """Bits in which a pair at the threshold differs but for a chance of a few in ten thousand."""
    apart = acos(max(-1.0, min(1.0, threshold))) / pi
    return min(bits, ceil(bits * apart + 3.5 * sqrt(bits * apart * (1 - apart))))


def plan_tables(n: int, threshold: float) -> tuple[int, int]:
    """Bits of a block, and number of tables."""
    width = min(30, max(4, ceil(log2(max(n, 1) / BUCKET)))) if n > BUCKET else 4
    apart = acos(max(-1.0, min(1.0, threshold))) / pi
    agree = (1 - apart) ** width
    tables = max(1, ceil(log(MISS) / log(1 - agree))) if agree < 1 else 1
    if width * tables > CODE:  # blocks are drawn from one code, so a pair that differs much misses in all tables at once
        chance = [comb(CODE, h) * apart**h * (1 - apart) ** (CODE - h) for h in range(CODE + 1)]
        meets = [comb(CODE - h, width) / comb(CODE, width) for h in range(CODE + 1)]
        while sum(c * (1 - m) ** tables for c, m in zip(chance, meets, strict=True)) > MISS:
            tables += 1
    return width, tables


def block_places(width: int, tables: int) -> np.ndarray:
    """The bits of the block of each table, a row each."""
    if width * tables <= CODE:
        return np.arange(width * tables).reshape(tables, width)
    r = np.random.default_rng(11)
    return np.stack([r.permutation(CODE)[:width] for _ in range(tables)])


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their greatest component first, so that squares neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))


def learn_rotations(sample: np.ndarray, bits: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): signs of (x - mean) @ projection are at least bits balanced bits."""
    d = sample.shape[1]
    mean = sample.mean(0)
    centred = sample - mean
    axes = np.linalg.svd(centred.T @ centred)[0]
    turned, r, parts = centred @ axes, np.random.default_rng(seed), []
    for _ in range(-(-bits // d)):
        rotation = np.linalg.qr(r.standard_normal((d, d)))[0]
        for _ in range(ROUNDS):
            u, _, vt = np.linalg.svd(np.where(turned @ rotation >= 0, 1.0, -1.0).T @ turned)
            rotation = vt.T @ u.T
        parts.append(axes @ rotation)
    return mean, np.concatenate(parts, 1)[:, :bits]


def _bits(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    mean, projection = model
    return ((x - mean) @ projection >= 0).astype(np.uint8)


def near_vectors(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vectors(vec_id, embedding) as (vec_id, n_links, component_id, kept)."""
    element = vectors.schema["embedding"].dataType.elementType.simpleString()
    v = F.col("embedding") if element in ("float", "double") else F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v"))
    size = F.size("v")
    valid = F.coalesce(F.col("v").isNotNull() & (size > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("valid", valid).withColumn("k1", F.xxhash64("v")).withColumn("k2", F.xxhash64(F.lit("second"), "v"))
    classes = rows.where("valid").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v"))
    classes = checkpointed(classes.withColumn("cid", F.monotonically_increasing_id()))
    sizes = classes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width, tables = plan_tables(classes.count(), threshold)
    places = block_places(width, tables)
    n_bits = int(places.max()) + 1 if width * tables <= CODE else CODE
    d = sizes[0]["d"]
    sample = classes.where(F.size("v") == d).orderBy(F.xxhash64("k1")).limit(TRAIN).select("v").toArrow()["v"].combine_chunks()
    model = learn_rotations(unit(np.asarray(sample.flatten(), float).reshape(-1, d)), n_bits)
    reach = radius(n_bits, threshold)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        others: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            long = np.diff(np.asarray(batch.column("v").offsets))
            for n in np.unique(long).tolist():
                some = batch.filter(pa.array(long == n))
                x = unit(np.asarray(some.column("v").flatten(), float).reshape(-1, n))
                if n != d and n not in others:  # the few vectors of another length get random rotations
                    r = np.random.default_rng(n)
                    others[n] = np.zeros(n), np.concatenate([np.linalg.qr(r.standard_normal((n, n)))[0] for _ in range(-(-n_bits // n))], 1)[:, :n_bits]
                bits = _bits(x, model if n == d else others[n])
                codes = bits[:, places].astype(np.int32) @ (1 << np.arange(width, dtype=np.int32))
                blocks = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * tables), pa.array(codes.ravel().astype(np.int32)))
                packed = pa.array([a.tobytes() for a in np.packbits(bits, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("cid"), pa.array(np.full(len(x), n, np.int32)), blocks, packed], ["cid", "d", "codes", "bits"])

    coded = checkpointed(classes.select("cid", "v").mapInArrow(encode, "cid bigint, d int, codes array<int>, bits binary"))
    keys = ["d", "t", "code", "_i", "_j"]
    met = group_plan(coded.select("cid", "d", F.posexplode("codes").alias("t", "code")), ["d", "t", "code"], F.col("cid"), PART).join(coded.select("cid", "bits"), "cid")

    def near(group: pa.Table) -> np.ndarray:
        """Which two rows of a group lie within the radius and meet in no table before this one."""
        t, side = group["t"][0].as_py(), np.asarray(group["_own"])
        bits = np.unpackbits(np.frombuffer(b"".join(group["bits"].to_pylist()), np.uint8).reshape(group.num_rows, -1), axis=1, count=n_bits)
        sign = bits.astype(np.float32) * 2 - 1
        close = sign @ sign.T >= n_bits - 2 * reach
        np.fill_diagonal(close, False)
        if group["_i"][0] != group["_j"][0]:
            close &= side[:, None] != side[None]
        a, b = np.nonzero(close) if t else ((), ())
        for at in range(0, len(a), 1 << 13):
            x, y = a[at : at + (1 << 13)], b[at : at + (1 << 13)]
            same = (bits[x] == bits[y])[:, places[:t]].all(2).any(1)
            close[x[same], y[same]] = False
        return close

    def partners(group: pa.Table) -> pa.RecordBatch | None:
        some = pa.array(np.flatnonzero(near(group).any(1)))
        return group.select([*keys, "_own", "cid"]).take(some).combine_chunks().to_batches()[0] if len(some) else None

    fetched = by_key(met.select(*keys, "_own", "cid", "bits"), keys, partners, "d int, t int, code int, _i int, _j int, _own int, cid bigint")
    fetched = checkpointed(fetched).join(coded.select("cid", "bits"), "cid").join(classes.select("cid", "weight", "v"), "cid")

    def work(group: pa.Table) -> pa.RecordBatch | None:
        x = unit(np.asarray(group["v"].combine_chunks().flatten(), float).reshape(group.num_rows, -1))
        cid, weight = np.asarray(group["cid"]), np.asarray(group["weight"])
        linked = near(group) & (x @ x.T >= threshold)
        if not linked.any():
            return None
        count = linked @ weight
        root = cid[roots(linked)]
        some = np.flatnonzero(count > 0)
        return pa.RecordBatch.from_arrays([pa.array(cid[some]), pa.array(count[some]), pa.array(root[some])], ["cid", "n", "root"])

    found = checkpointed(by_key(fetched.select(*keys, "_own", "cid", "weight", "bits", "v"), keys, work, "cid bigint, n bigint, root bigint"))
    linked = components(found.select(F.col("cid").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("cid"), F.col("component").alias("root"))
    named = classes.select("k1", "k2", "cid", "least", "weight").join(linked, "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    named = named.join(found.groupBy("cid").agg(F.sum("n").alias("n")), "cid", "left")
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(least, "root").select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).cast("bigint").alias("n_links"), "component_id", "weight")
    out = spread_join(rows.where("valid").select("vec_id", "k1", "k2"), named, ["k1", "k2"], "weight").select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where(~F.col("valid")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.9)


QUERIES = {"op1_embedding_dedup": op1_embedding_dedup}
ORACLE_SQL: dict[str, str] = {}
