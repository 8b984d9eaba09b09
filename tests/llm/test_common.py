import random

import numpy as np

from folioquery.llm import common as C


def test_components_against_union_find(spark):
    r = random.Random(9)
    cases = [[], [(1, 1)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], [(99, i) for i in range(50)], [(r.randrange(300), r.randrange(300)) for _ in range(220)]]
    for edges in cases:
        root = {x: x for e in edges for x in e}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
        want = {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}
        df = spark.createDataFrame(edges, "a long, b long")
        out = C.components(df).collect()
        assert len(out) == len(want) and {o["id"]: o["component"] for o in out} == want


def test_stars_need_no_round_and_a_path_none_to_confirm(spark, monkeypatch):
    rounds, join = [], C.spread_join
    monkeypatch.setattr(C, "spread_join", lambda *a: rounds.append(1) or join(*a))
    stars = [(0, i) for i in range(1, 40)] + [(i, 100) for i in range(101, 120)] + [(7, 0)]
    out = C.components(spark.createDataFrame(stars, "a long, b long")).collect()
    assert sorted(map(tuple, out)) == [(i, 0) for i in range(40)] + [(i, 100) for i in range(100, 120)] and not rounds
    assert C.components(spark.createDataFrame([], "a long, b long")).count() == 0 and not rounds
    assert {r["component"] for r in C.components(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")).collect()} == {1} and len(rounds) == 1


def test_a_round_joins_each_edge_once(spark, monkeypatch):
    """A group of n near copies that m lists hold comes as up to m * n edges, and so many rows are joined, not their mirror images too."""
    joined, join = [], C.spread_join

    def spread(rows, *a):
        joined.append(rows.count())
        return join(rows, *a)

    monkeypatch.setattr(C, "spread_join", spread)
    r = random.Random(5)
    for n in (200, 800):
        edges = {(max(e), min(e)) for _ in range(6) for m in [r.sample(range(n), n // 2)] for e in [(m[0], x) for x in m[1:]]}
        joined.clear()
        out = C.components(spark.createDataFrame(sorted(edges), "a long, b long")).collect()
        assert len({o["component"] for o in out}) == 1 and len(out) == len({x for e in edges for x in e})
        assert joined[0] == len(edges) and max(joined) <= len(edges)


def test_spread_join_equals_join(spark, monkeypatch):
    monkeypatch.setattr(C, "HUBS", 3)
    rows = spark.range(600).selectExpr("CASE WHEN id % 3 = 0 THEN 1 WHEN id % 7 = 0 THEN 2 ELSE id % 50 END AS k", "id AS x", "1 AS _hub")
    stats = rows.groupBy("k").count().where("k <> 5")
    want = rows.join(stats, "k").select("k", "x", "_hub", "count").collect()
    assert sorted(C.spread_join(rows, stats, ["k"], "count").collect()) == sorted(want)
    assert C.spread_join(rows.limit(0), stats.limit(0), ["k"], "count").count() == 0


def test_hashes_of_runs():
    r = random.Random(6)
    words = [bytes(r.randrange(256) for _ in range(n)) for n in [1, 1, 2, 63, 64, 65, 66, 5000, *[r.randrange(1, 90) for _ in range(300)]]]
    words += ["".join("ab"[(i.bit_count() + k) % 2] for i in range(1024)).encode() for k in (0, 1)] + [b"a", b"a\0", b"\0a", b"x" * 70, b"x" * 71]
    words += words[::-1]
    long = np.array([len(w) for w in words])
    got = C.run_hashes(np.frombuffer(b"".join(words), np.uint8), np.cumsum(long) - long, long).tolist()
    assert got == got[::-1] and len(set(got)) == len(set(words))
