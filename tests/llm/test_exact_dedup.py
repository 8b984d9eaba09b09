import hashlib
import random

import pytest
from pyspark.sql import functions as F

from folioquery.llm import exact_dedup as E

SCHEMA = "doc_id long, text string, key string, n int"


def expected(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out = []
    for d, t in rows:
        ids = groups[t or ""]
        keep = max((x for x in ids if x is not None), default=None)
        out.append((d, keep, len(ids), d == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


def given():
    r = random.Random(4)
    texts = ["a", "A", "a ", "ab", "ba", "", None, "é", "é", "x" * 300_000, "x" * 299_999 + "y"] + [f"text {i}" for i in range(150)]
    rows = [(i, r.choice(texts[:11] if i % 3 else ["hot copy"])) for i in range(400)] + [(1000 + i, t) for i, t in enumerate(texts)]
    return r.sample(rows, len(rows)) + [(7, "twice"), (7, "twice"), (None, "no id"), (None, "a")]


def weak(bits):
    return lambda text: F.pmod(F.xxhash64(text), F.lit(1 << bits))


@pytest.mark.parametrize(("hash_of", "capacity"), [(F.xxhash64, 8), (weak(0), 4096), (weak(3), 40), (lambda t: -F.length(t).cast("bigint"), 4096)])
def test_against_brute_force(spark, hash_of, capacity):
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in given()], SCHEMA)
    out = E.copies(df, capacity, hash_of)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == expected(given())


def test_directory(spark):
    df = spark.createDataFrame([(d, t, "", 1) for d, t in given()], SCHEMA)
    for hash_of, capacity in ((F.xxhash64, 4), (weak(3), 5), (lambda t: F.length(t).cast("bigint"), 1)):
        folder = E.build(df, capacity, hash_of)
        index, slots = spark.read.parquet(f"{folder}/index"), spark.read.parquet(f"{folder}/directory").collect()
        assert index.count() == len({t or "" for _, t in given()})
        buckets = {}
        for x in index.collect():
            buckets.setdefault((x["bucket"], x["local_depth"]), []).append(x)
        assert set(buckets) == {(s["bucket"], s["local_depth"]) for s in slots}
        top = lambda key, d: (key % 2**64) >> (64 - d) if d else 0
        for (low, depth), held in buckets.items():
            assert len(held) <= capacity or len({x["key"] for x in held}) == 1  # only a chain may overflow
            assert len({top(x["key"], depth) for x in held}) == 1 and (depth == 0 or top(low, depth) == top(held[0]["key"], depth))
        assert len(buckets) == len({b for b, _ in buckets})


def test_empty_and_without_copies(spark):
    df = spark.createDataFrame([(d, t, "clash", 1) for d, t in given()], SCHEMA)
    assert E.copies(df.limit(0)).count() == 0 and E.without_copies(df.limit(0)).count() == 0
    stays = E.without_copies(df.withColumn("_key", F.lit(1)))
    assert stays.columns == [*df.columns, "_key"]
    want = {(e[0], e[4]) for e in expected(given()) if e[3]}
    assert {(x["doc_id"], hashlib.sha256((x["text"] or "").encode()).hexdigest()) for x in stays.collect()} == want
