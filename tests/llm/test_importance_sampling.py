import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioquery.llm import byte_automaton as B
from folioquery.llm import importance_sampling as I

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def buckets(text, run=3, n=10_000):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + k]).encode()) % n for k in range(1, run + 1) for i in range(len(w) - k + 1)]


def expected(docs, target, percent=5, least=20):
    s, t = Counter(b for _, x in docs for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    rows = []
    for d, x in docs:
        own = buckets(x)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        rows.append((d, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    open_to = sorted((r for r, (_, x) in zip(rows, docs, strict=True) if len(words(x)) >= least), key=lambda r: (-r[3], r[0] is not None, r[0]))
    rank = {r: i + 1 for i, r in enumerate(open_to[: percent * len(open_to) // 100])}
    return sorted(((*r, rank.get(r)) for r in rows), key=repr)


def test_crc_of_many_strings():
    r = random.Random(1)
    texts = [bytes(r.randrange(256) for _ in range(n)) for n in [0, 1, 2, 63, 64, 65, 700, *[r.randrange(20) for _ in range(200)]]]
    data = np.frombuffer(b"".join(texts), np.uint8)
    long = np.array([len(t) for t in texts])
    start = np.cumsum(long) - long
    seeds = np.array([zlib.crc32(b"%d" % i) for i in range(len(texts))], np.uint32)
    assert B.advanced(seeds, data, start, long).tolist() == [zlib.crc32(t, int(s)) for t, s in zip(texts, seeds, strict=True)]
    assert B.advanced_byte(seeds, 32).tolist() == [zlib.crc32(b" ", int(s)) for s in seeds]
    assert not len(B.advanced(seeds[:0], data, start[:0], long[:0]))


def test_features_of_texts():
    texts = [None, "", " ", "a", "A b", "one,two three", "é" * 300 + " x", "x y zÀ\x7f9", "漢字 かな", "end", "start again and", "\x00"]
    got = I.features(pa.array(texts))
    for i, t in enumerate(texts):
        assert sorted(got.bucket[got.text == i].tolist()) == sorted(buckets(t)) and got.n_words[i] == len(words(t))
    sliced = I.features(pa.array(["before", *texts, "after"]).slice(1, len(texts)), 2, 7)
    assert Counter(sliced.bucket.tolist()) == Counter(b for t in texts for b in buckets(t, 2, 7))


def given():
    r = random.Random(2)
    vocabulary = [f"{a}{b}" for a in ("Al", "be", "çè", "漢") for b in ("pha", "TA", "", "9")]
    docs = [(i, r.choice([" ", ", "]).join(r.choices(vocabulary, k=r.choice([0, 5, 19, 20, 60])))) for i in range(300)]
    docs += [(500 + i, "same text " * 12) for i in range(150)] + [(900, None), (901, ""), (902, "w" * 100_000), (903, "long words " * 30_000), (None, "no id " * 15)]
    target = ["alpha beta çè", "same text", None, ""]
    return r.sample(docs, len(docs)), target


def test_against_brute_force(spark):
    docs, target = given()
    df = spark.createDataFrame([(d, x, 1, "s") for d, x in docs], "doc_id long, text string, rank int, score string")
    goal = spark.createDataFrame([(x, 1) for x in target], "text string, n int")
    for percent in (5, 100):
        out = I.resampled(df, goal, percent)
        assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert sorted(map(tuple, out.collect()), key=repr) == expected(docs, target, percent)


def test_repeats_and_empty_tables(spark):
    docs, _ = given()
    docs = docs[:50] + docs[:50]
    df, none = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "text string")
    out = I.resampled(df, none, 50)
    want = expected(docs, [], 50)
    assert sorted(tuple(x)[:4] for x in out.collect()) == sorted(w[:4] for w in want)
    n = sum(len(words(x)) >= 20 for _, x in docs) // 2
    assert sorted(x["rank"] for x in out.where("rank IS NOT NULL").collect()) == list(range(1, n + 1))
    assert I.resampled(df.limit(0), none).count() == 0
    assert I.bucket_counts(df).agg(F.sum("n")).first()[0] == sum(len(buckets(x)) for _, x in docs)


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    target = [x[0] for x in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect()]
    assert sorted(map(tuple, I.op12_importance_sampling(spark, sf).collect()), key=repr) == expected(docs, target)
