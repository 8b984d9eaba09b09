import pytest
import random
import math
import zlib

import numpy as np
import pyarrow as pa

from folioquery.llm import toxicity as T
from folioquery.llm.common import table, words_of

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    out = {r["doc_id"]: r for r in T.op2_toxicity(spark, SF).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, SF, "labels").collect()}
    assert len(out) == table(spark, SF, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in out.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    held = [(labels[i], r["score"]) for i, r in out.items() if i in labels and r["held_out"]]
    pos, neg = ([s for y, s in held if y == k] for k in (1, 0))
    assert np.searchsorted(np.sort(neg), pos).mean() / len(neg) > 0.97
    assert np.mean([(s >= 0.5) == y for y, s in held]) > 0.95
    assert np.mean(np.array(neg) >= 0.5) < 0.02


def test_features_see_whole_texts_and_no_borders():
    cells, first = T.features(words_of(pa.array(["x y z", "u v", "x y z u v", "", "X  Y z"]), lower=True))
    a, b, ab, empty, again = (set(c.tolist()) for c in np.split(cells, first[1:-1]))
    assert a | b < ab and not empty and a == again and not a & b


def test_edges(spark):
    rows = [(1, "good words here", 0), (2, "bad idiot", 1), (3, None, 1), (None, "bad idiot", 1), (1, "", None), (4, "x " * 50_000, 0)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, label int, cell string")
    model = T.train(docs)
    out = T.score(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    none = T.train(docs.limit(0))
    assert {round(r["score"], 9) for r in T.score(docs, none).collect()} == {0.25}
    assert all(r["score"] > 0.5 for r in T.score(docs, T.train(docs.where("label = 1"))).collect())
    assert T.score(docs.limit(0), none).count() == 0


def test_sample_is_bounded(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('w', id % 7, if(id % 3 = 0, ' foul', '')) AS text", "cast(id % 3 = 0 AS int) AS label")
    at, weight, bias = T.train(docs, sample=100, shards=2)
    assert len(at) == len(weight) <= 1 << T.BITS
    score = {r["doc_id"]: r["score"] for r in T.score(docs, (at, weight, bias)).collect()}
    assert np.mean([(s > 0.5) == (i % 3 == 0) for i, s in score.items()]) > 0.95


def plain_ftrl(rows, prior, z=None, n=None, times=1):
    """One pass of FTRL-proximal over (coordinates, label), written out per coordinate."""
    z, n = dict(z or {}), dict(n or {})
    for cells, y in rows:
        w = {}
        for c in cells:
            zc = z.get(c, 0.0)
            w[c] = 0.0 if abs(zc) <= T.L1 else -(zc - math.copysign(T.L1, zc)) / ((T.BETA + math.sqrt(n.get(c, 0.0))) / T.ALPHA + T.L2)
        g = 1 / (1 + math.exp(-(prior + sum(w.values())))) - y
        for c in cells:
            new = n.get(c, 0.0) + times * g * g
            z[c] = z.get(c, 0.0) + times * g - (math.sqrt(new) - math.sqrt(n.get(c, 0.0))) / T.ALPHA * w[c]
            n[c] = new
    return z, n


def labelled_texts():
    r = random.Random(12)
    make = lambda bad: " ".join(r.choice(["calm", "kind", "river", "stone", "walk"] + ["vile", "awful"] * 2 * bad) for _ in range(r.randrange(3, 25)))
    return [(i, make(i % 4 == 0), int(i % 4 == 0)) for i in range(300)]


def test_learning_equals_plain_ftrl():
    rows = labelled_texts()
    cells, first = T.features(T.words_of(pa.array([t for _, t, _ in rows]), lower=True))
    want_z, want_n = plain_ftrl([(cells[a:b].tolist(), y) for a, b, (_, _, y) in zip(first[:-1], first[1:], rows)], -1.0)
    z, n = T._learn((np.zeros(1 << T.BITS), np.zeros(1 << T.BITS)), pa.array([t for _, t, _ in rows]), np.array([y for _, _, y in rows]), -1.0, T.BITS)
    assert set(np.flatnonzero(n).tolist()) == set(want_n)
    assert all(abs(z[c] - want_z[c]) < 1e-9 and abs(n[c] - want_n[c]) < 1e-9 for c in want_n)


def test_training_equals_plain_rounds(spark):
    """With one shard a round is one pass in the order of the hash; sums travel in half precision, so weights agree to a few thousandths."""
    rows = labelled_texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    at, weight, prior = T.train(frame, shards=1, rounds=3)
    order = [r["doc_id"] for r in frame.selectExpr("doc_id", "xxhash64('order', doc_id, text, label) AS h").orderBy("h").collect()]
    cells, first = T.features(T.words_of(pa.array([rows[i][1] for i in order]), lower=True))
    seen = [(cells[a:b].tolist(), rows[i][2]) for a, b, i in zip(first[:-1], first[1:], order)]
    z, n = {}, {}
    for _ in range(3):
        z, n = plain_ftrl(seen, prior, z, n)
    want = {c: -(x - math.copysign(T.L1, x)) / ((T.BETA + math.sqrt(n[c])) / T.ALPHA + T.L2) for c, x in z.items() if abs(x) > T.L1}
    got = dict(zip(at.tolist(), weight.tolist()))
    assert want and all(abs(got.get(c, 0.0) - want.get(c, 0.0)) < 0.02 for c in {*got, *want})
    assert len(set(got) ^ set(want)) <= 0.05 * len(want)


def test_too_many_rows_for_half_precision_raise(spark):
    big = np.zeros(4)
    held = type("Held", (), {"value": (big.astype(np.float32), big.astype(np.float32))})()
    learn = T._learner(held, 0.0, 2, 1)
    T_learn, T._learn = T._learn, lambda *_: (big + 1e6, big)
    try:
        with pytest.raises(ValueError, match="more shards"):
            list(learn(iter([pa.RecordBatch.from_pydict({"text": ["a"], "label": [1]})])))
    finally:
        T._learn = T_learn


def test_driver_gets_sums_whatever_the_shards(spark, monkeypatch):
    frame = spark.createDataFrame(labelled_texts(), "doc_id long, text string, label int")
    collect, got = type(frame).collect, []
    monkeypatch.setattr(type(frame), "collect", lambda self: got.append(rows := collect(self)) or rows)
    one = T.train(frame, bits=16, shards=5, rounds=2)
    sizes = [sum(len(x) for r in rows for x in r if isinstance(x, bytes | bytearray)) for rows in got]
    assert [n for n in sizes if n] == [8 << 16] * 2
    assert len(one[0]) and all(np.array_equal(a, b) for a, b in zip(one, T.train(frame, bits=16, shards=5, rounds=2)))


def test_sums_of_half_precision_lose_nothing():
    parts = np.array([[60000, 2**-24, 1], [60000, 60000, -1], [1, -60000, 0.5]], np.float16)
    both = [pa.array([p.tobytes() for p in parts], pa.binary())] * 2
    out = T._added(pa.table([pa.array([3] * 3, pa.int32()), *both], ["chunk", "dz", "dn"]))
    assert out.num_rows == 1 and out.column("chunk").to_pylist() == [3]
    assert np.frombuffer(out.column("dz")[0].as_py(), np.float32).tolist() == parts.astype(float).sum(0).astype(np.float32).tolist()
