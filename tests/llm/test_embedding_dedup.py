import numpy as np

from folioquery.llm import embedding_dedup as E
from folioquery.llm.common import table


def expected(rows, threshold=0.9):
    """(vec_id, n_links, component_id) of each row by all cosines."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    linked = {i: set() for i in range(len(rows))}
    for d in {len(rows[i][1]) for i in good}:
        some = [i for i in good if len(rows[i][1]) == d]
        x = E.unit(np.array([rows[i][1] for i in some], float))
        for a, b in zip(*np.nonzero(x @ x.T >= threshold)):
            if a != b:
                linked[some[a]].add(some[b])
    out, root = [], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, js in linked.items():
        for j in js:
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    for i, (d, _) in enumerate(rows):
        out.append((d, len(linked[i]), least.get(find(i)) if i in good else d))
    return sorted(out, key=repr)


def run(spark, rows, kind="double"):
    df = spark.createDataFrame([(i, v, 3, 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, weight int, v int")
    out = E.near_vectors(df).collect()
    assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in out)
    return sorted(((x["vec_id"], x["n_links"], x["component_id"]) for x in out), key=repr)


def test_clusters_copies_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(E, "PART", 20)
    monkeypatch.setattr(E, "BUCKET", 8)
    r = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((300, 32)))]
    for n in (2, 6, 120):
        centre = r.standard_normal(32)
        rows += [(len(rows) + i, (centre + 0.02 * r.standard_normal(32)).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[5][1]) for i in range(40)] + [(2000, [2 * x for x in rows[6][1]]), (2001, [1e200 * x for x in rows[7][1]]), (2002, [-x for x in rows[8][1]])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 32), (3003, [float("nan")] * 32), (3004, [None] + [1.0] * 31), (3005, [float("inf")] + [1.0] * 31)]
    rows += [(4000, [1.0, 0.0]), (4001, [1.0, 0.1]), (4002, [0.0, 1.0]), (None, rows[9][1]), (10, rows[11][1]), (10, rows[11][1]), (None, [0.0])]
    r.shuffle(rows)
    assert run(spark, rows) == expected(rows)


def test_recall_at_the_threshold(spark):
    """Pairs placed at the threshold, among vectors enough for narrow blocks."""
    r = np.random.default_rng(3)
    x = E.unit(r.standard_normal((20_000, 64)))
    y = r.standard_normal((2_000, 64))
    y -= (y * x[:2_000]).sum(1, keepdims=True) * x[:2_000]
    pairs = 0.9005 * x[:2_000] + np.sqrt(1 - 0.9005**2) * E.unit(y)
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, pairs]))]
    out = run(spark, rows)
    found = sum(n > 0 for i, n, _ in out if i >= 20_000)
    assert found >= 0.93 * 2_000


def test_recall_with_blocks_drawn_from_one_code(spark, monkeypatch):
    """As for very many vectors: a code too short for blocks side by side."""
    assert E.plan_tables(10**9, 0.9)[0] * E.plan_tables(10**9, 0.9)[1] > E.CODE == 256 and E.block_places(22, 150).shape == (150, 22)
    monkeypatch.setattr(E, "CODE", 48)
    monkeypatch.setattr(E, "BUCKET", 8)
    width, tables = E.plan_tables(4_000, 0.9)
    assert width * tables > 48 >= E.plan_tables(100, 0.99)[0] * E.plan_tables(100, 0.99)[1]
    r = np.random.default_rng(4)
    x = E.unit(r.standard_normal((3_000, 32)))
    y = r.standard_normal((1_000, 32))
    y -= (y * x[:1_000]).sum(1, keepdims=True) * x[:1_000]
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([x, 0.9005 * x[:1_000] + np.sqrt(1 - 0.9005**2) * E.unit(y)]))]
    out = run(spark, rows)
    assert sum(n > 0 for i, n, _ in out if i >= 3_000) >= 0.93 * 1_000
    assert all(n <= m for (_, n, _), (_, m, _) in zip(out, expected(rows), strict=True))  # no link below the threshold, none counted twice


def test_few_vectors_are_fetched(spark):
    """Of vectors without a near one only those within the radius by chance leave the tables."""
    r = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(r.standard_normal((3_000, 64)))]
    assert run(spark, rows, "float") == [(i, 0, i) for i in sorted(range(3_000), key=lambda i: repr((i, 0, i)))]
    assert E.radius(88, 0.9) == 25 and E.radius(10, -1.0) == 10


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert E.near_vectors(df).count() == 0
    one = spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")
    assert [tuple(x) for x in E.near_vectors(one).collect()] == [(1, 0, 1, True)]


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(x["vec_id"], list(x["embedding"])) for x in table(spark, sf, "embeddings").collect()]
    out = E.op1_embedding_dedup(spark, sf).collect()
    assert sorted(((x["vec_id"], x["n_links"], x["component_id"]) for x in out), key=repr) == expected(rows)
