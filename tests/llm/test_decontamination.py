import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from folioquery.llm import decontamination as D
from folioquery.llm.common import table, words_of


def words(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def grams(w):
    k = min(5, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def expected(docs, items, threshold=0.8):
    """(row, item) -> greatest similarity, over every window of the item's length."""
    split = [(i, words(t)) for i, t in items]
    sharing, short = {}, [k for k, (_, item) in enumerate(split) if len(item) < 5]
    for k, (_, item) in enumerate(split):
        for g in grams(item):
            sharing.setdefault(g, []).append(k)
    out = {}
    for row, (_, text) in enumerate(docs):
        w = words(text)
        for i, item in (split[k] for k in {*short, *(k for g in grams(w) for k in sharing.get(g, ()))}):
            if not item or not w:
                continue
            want, best = grams(item), 0
            if not set(want) & set(grams(w)) and len(item) >= 5:
                continue
            for s in range(max(1, len(w) - len(item) + 1)):
                run = w[s : s + len(item)]
                if len(run) < min(5, len(item)):
                    continue
                have = grams(run)
                common = (want & have).total()
                best = max(best, common / (want.total() + have.total() - common))
            if best >= threshold - 1e-12:
                out[row, i] = best
    return out


def test_against_brute_force(spark):
    r = random.Random(6)
    vocab = [f"w{i}" for i in range(200)] + ["Ä", "x", "the"]
    make = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(make(n))) for i, n in enumerate([1, 3, 4, 5, 6, 15, 15, 16, 37, 59, 59, 70])]
    items += [(90, ""), (91, None), (92, "! ?"), (93, items[9][1].upper() + "."), (None, " ".join(make(30))), (94, " ".join(["a", "b"] * 12))]
    docs = []
    for n in range(260):
        parts = make(r.randrange(0, 60))
        w = (r.choice([t for _, t in items if t]) or "").split()
        for _ in range(r.choice([0, 0, 1, 2])):
            if w:
                e = r.randrange(len(w))
                w = r.choice([w[:e] + w[e + 1 :], w[:e] + make(1) + w[e:], w[:e] + make(1) + w[e + 1 :], w[1:], w[:-1]])
        docs.append((n, r.choice([" ", "  ", ", ", "\n"]).join(parts + w + (make(r.randrange(0, 40)) if r.random() < 0.7 else []))))
    docs += [(500, None), (501, ""), (None, items[5][1]), (5, items[5][1]), (5, items[5][1]), (502, "a b " * 3000)]
    want = expected(docs, items)
    assert len(want) > 80
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, start int")
    bench = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id long, text string, k string")
    rows = Counter((d, i, round(s, 9)) for (row, i), s in want.items() for d in [docs[row][0]])
    out = D.contaminated(df, bench).collect()
    assert Counter((x["doc_id"], x["item_id"], round(x["similarity"], 9)) for x in out) == rows
    clean = D.uncontaminated(df, bench)
    assert clean.columns == df.columns
    leaks = {row for row, _ in want}
    assert Counter(tuple(x) for x in clean.collect()) == Counter((d, t, 1) for row, (d, t) in enumerate(docs) if row not in leaks)
    assert D.uncontaminated(df.limit(0), bench).count() == 0 and D.uncontaminated(df, bench.limit(0)).count() == len(docs)
    assert D.contaminated(df.limit(0), bench).count() == 0
    assert D.contaminated(df, bench.limit(0)).count() == 0


def test_blocks_find_all_within_radius(spark):
    r = np.random.default_rng(2)
    prints = r.integers(0, 2**64, 50, dtype=np.uint64)
    probes = []
    for flips in (0, 5, D.RADIUS, D.RADIUS + 1):
        for m in range(50):
            probe = int(prints[m])
            for bit in r.choice(64, flips, replace=False).tolist():
                probe ^= 1 << bit
            probes.append((len(probes), m, flips, probe - (1 << 64) if probe >> 63 else probe))
    one = spark.createDataFrame(probes, "p int, m int, flips int, print long").select("p", "m", "flips", D._posts(False))
    two = spark.createDataFrame(list(enumerate(prints.view(np.int64).tolist())), "i int, print long").select("i", D._posts(True))
    met = {(x["p"], x["i"]) for x in one.join(two, ["block", "value"]).select("p", "i").distinct().collect()}
    assert all((p, m) in met for p, m, flips, _ in probes if flips <= D.RADIUS)


def test_filter_says_yes_to_all_it_knows(spark):
    r = np.random.default_rng(4)
    sets = [(n, r.integers(0, 2**64, 40, dtype=np.uint64)) for n in (3, 9, 9, 30)]
    contents = spark.createDataFrame([(n, x.tobytes()) for n, x in sets], "n int, shingles binary")
    for most in (1 << 16, 1 << 28):
        known = D.filter_of(contents, most)
        assert all(known.has(D._of_length(x, n)).all() and (n < 5 or known.has(x).all()) for n, x in sets)
        assert known.has(r.integers(0, 2**64, 10_000, dtype=np.uint64)).mean() < 0.01 and not known.has(D._of_length(sets[3][1], 9)).any()


def test_many_items_and_recall_near_the_threshold(spark):
    """25,000 items; passages edited to be just above or below the threshold, in copies too; a text longer than a slice."""
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(5000)]
    make = lambda n: [r.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(make(r.choice([8, 12, 20, 21, 40, 90, 200])))) for i in range(25_000)]
    docs = []
    for n in range(700):
        w = items[r.randrange(25_000)][1].split()
        k = max(1, len(w) // 9 - 4)
        at = r.randrange(len(w))
        w = r.choice([w, w[:at] + make(1) + w[at + 1 :], w[:at] + make(k) + w[at + k :], w[k:], w[: -k - 1], w[:at] + make(2) + w[at:]])
        docs.append((n, " ".join(make(30) + w + make(20))))
    docs += [(700 + i, docs[5][1]) for i in range(300)] + [(1000, " ".join(make(200_000) + items[7][1].split() + make(5)))]
    out = {(x["doc_id"], x["item_id"]): round(x["similarity"], 9) for x in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {(docs[row][0], i): round(s, 9) for (row, i), s in expected(docs, items).items()}
    assert len(want) > 550 and (1000, 7) in want and all(want.get(x) == s for x, s in out.items())
    missed = len(set(want) - set(out)) / len(want)
    assert missed <= 0.005, missed


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(x["doc_id"], x["text"]) for x in table(spark, sf, "documents").collect()]
    items = [(x["item_id"], x["text"]) for x in table(spark, sf, "benchmark").collect()]
    out = {(x["doc_id"], x["item_id"]): round(x["similarity"], 9) for x in D.op4_decontamination(spark, sf).collect()}
    want = {(docs[row][0], i): round(s, 9) for (row, i), s in expected(docs, items).items()}
    assert want and out == want


def test_long_items_in_bounded_memory(spark):
    """An item of 20,000 words and a text that holds it but for some words: windows are found as ranges, not as all places times all offsets."""
    r = random.Random(12)
    words = [f"w{r.randrange(10**6)}" for _ in range(20_000)]

    class Every:
        def has(self, values):
            return np.ones(len(values), bool)

    text = words_of(pa.array([" ".join(words), " ".join(words[:19_000])]), lower=True, letters=True)
    tracemalloc.start()
    found = [(n, long, len(s)) for n, long, s, _ in D.windows(text, Every(), [6_000, 20_000], 0.8)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == [(6_000, 6_000, 14_001 + 13_001), (20_000, 20_000, 1), (20_000, 19_000, 1)] and peak < 40_000_000
    edited = ["x" if i % 400 == 7 else w for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, " ".join(edited)), (2, " ".join(["before", *edited, "after"])), (3, " ".join(words[:9_000])), (4, "clean")], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(words))], "item_id long, text string")
    assert sorted(x["doc_id"] for x in D.uncontaminated(docs, items).collect()) == [3, 4]
