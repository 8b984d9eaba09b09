import random
import re

import numpy as np

from folioquery.llm import minhash_dedup as M
from folioquery.llm.common import table

LOWER = {i: i + 32 for i in range(65, 91)}


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def expected(rows, percent):
    """(doc_id, n, component, kept) of each row, by comparing every two sets."""
    sets = [shingle_set(t) for _, t in rows]
    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for i, s in enumerate(sets):
        seen = {}
        for x in s:
            for j in where[x]:
                if j < i:
                    seen[j] = seen.get(j, 0) + 1
        for j, n in seen.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), c := least.get(find(i)), d == c) for i, (d, _) in enumerate(rows)), key=repr)


def check(spark, rows, percent):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, k int")
    out = M.near_duplicates(df, percent).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out), key=repr) == expected(rows, percent)


def copies(r, n, base, words, edits):
    out = []
    for _ in range(n):
        w = base.split()
        for _ in range(r.randrange(edits)):
            w[r.randrange(len(w))] = r.choice(words)
        out.append(" ".join(w))
    return out


def test_groups_of_copies_ties_and_edges(spark, monkeypatch):
    monkeypatch.setattr(M, "PART", 16)  # so that groups are split
    monkeypatch.setattr(M, "LIST", 8)
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    texts = ["", None, " \t", "one", "ONE", "a b c", "A b c", "a b c d e", "a b c d", "x" * 10_000, "long " * 20_000, "Long " * 20_000, "É b c d e f", "é b c d e f"]
    for size in (2, 5, 90):
        for _ in range(4):
            texts += copies(r, size, " ".join(r.choice(words) for _ in range(120)), words, 5)
    texts += [" ".join(r.choice(words) for _ in range(80)) for _ in range(40)]
    rows = list(enumerate(texts))
    rows += [(None, texts[20]), (3, texts[30]), (3, texts[30]), (None, "only null here at all")]
    r.shuffle(rows)
    for percent in (85, 80):
        check(spark, rows, percent)


def test_empty_and_dedup(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert M.near_duplicates(none).count() == 0
    df = spark.createDataFrame([(1, "a b c d e f", "x"), (0, "A b c d e f", "y"), (2, None, "z"), (3, "", "z")], "doc_id long, text string, key string")
    assert {tuple(x) for x in M.deduplicated(df).collect()} == {(0, "A b c d e f", "y"), (2, None, "z"), (3, "", "z")}


def test_chain_of_candidates_that_stay_apart(spark, monkeypatch):
    """Texts on one template: all are candidates of each other by a low floor, and few are links."""
    monkeypatch.setattr(M, "PART", 12)
    monkeypatch.setattr(M, "LIST", 8)
    r = random.Random(8)
    base = [f"b{i}" for i in range(200)]
    texts = []
    for i in range(120):
        w, at = list(base), r.randrange(150)
        w[at : at + 24] = [f"own{i // 3}_{j}" for j in range(24)]
        texts.append(" ".join(w))
    check(spark, list(enumerate(texts)), 85)


def test_collisions_against_all_pairs():
    r = np.random.default_rng(3)
    for values, floor in ((2, 12), (3, 9), (50, 3), (10**6, 4)):
        rows = r.integers(0, values, (150, 24)).astype(np.uint32)
        rows[70:80] = rows[70]
        want = (rows[:, None] == rows[None]).sum(2) >= floor
        at, same = M.collisions(rows, floor)
        got = np.zeros((150, 150), bool)
        got[np.ix_(at, at)] = same >= floor
        np.fill_diagonal(want, False)
        np.fill_diagonal(got, False)
        assert (got == want).all()


def test_text_longer_than_a_slice(spark):
    long = " ".join(f"w{i}" for i in range(300_000))
    check(spark, [(1, long), (2, long + " end"), (3, "start " + long[: len(long) // 2])], 85)


def test_intersections_in_blocks():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 60, 30).astype(np.uint64)) for _ in range(9)] + [np.zeros(0, np.uint64)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for cells in (10, 50, 1 << 20):
        assert M.intersections(sets, cells).tolist() == want


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    out = M.op9_minhash_dedup(spark, sf).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in out), key=repr) == expected(rows, 85)


def mirrored(a="a", b="b", n=1024):
    """Two words that powers of any odd base modulo 2**64 cannot tell apart: the Thue-Morse order of two letters, and its complement."""
    return tuple("".join((a, b)[(i.bit_count() + k) % 2] for i in range(n)) for k in (0, 1))


def test_words_that_cancel_are_told_apart(spark):
    one, two = mirrored()
    rest = " ".join(f"w{i}" for i in range(12))
    check(spark, [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest}"), (4, one), (5, two)], 85)
