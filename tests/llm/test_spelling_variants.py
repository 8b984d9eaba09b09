import random
import re
import zlib
from collections import Counter

import pytest

from folioquery.llm import spelling_variants as S

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs, slip=199, least=6):
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                n[run] += 1
    return n


def edits(word, letters):
    out = {word[:i] + word[i + 1 :] for i in range(len(word))}
    out |= {word[:i] + c + word[i + 1 :] for i in range(len(word)) for c in letters}
    return (out | {word[:i] + c + word[i:] for i in range(len(word) + 1) for c in letters}) - {word}


def expected(n, least_n=5, ratio=5):
    n = {w: k for w, k in n.items() if k >= least_n}
    letters = {c for w in n for c in w}
    near = {w: [v for v in edits(w, letters) if v in n] if len(w) < 200 else [v for v in n if v in edits(w, "")] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= ratio * n[w]}
    rows = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(rows)


def made(seed=5, size=400):
    r = random.Random(seed)
    base = ["".join(r.choices("abéz", k=r.randrange(6, 10))) for _ in range(12)] + ["aaaaaaaa", "abababab", "ABCDEF", "çédille", "naïveté", "×÷×÷×÷"]
    words = []
    for w in base:
        for _ in range(r.choice([1, 6, 40])):
            words += [w] * 3
            i = r.randrange(len(w) + 1)
            words.append(r.choice([w[:i] + w[i + 1 :], w[:i] + r.choice("abéx") + w[i:], w[:i] + r.choice("abé") + w[i + 1 :]]))
    return [(i, r.choice([" ", ", ", "1", "\n"]).join(r.choices(words, k=r.randrange(30)))) for i in range(size)]


@pytest.mark.parametrize("part", [50_000, 20])
def test_against_brute_force(spark, monkeypatch, part):
    docs = made() + [(900, None), (901, ""), (902, "é"), (None, "naïveté " * 9), *[(i, "x" * 3000 + " " + "x" * 2999) for i in (1, 2, 3, 4, 5)], *[(7, "repeated rows")] * 9]
    df = spark.createDataFrame([(d, t, "w", 1) for d, t in docs], "doc_id long, text string, word string, n int")
    for slip in (199, 3):
        counts = counted(docs, slip)
        assert dict(map(tuple, S.words_counted(df, slip).collect())) == dict(counts)
    if part < 100:
        monkeypatch.setattr(S.near_words, "__defaults__", (6, None, part))
    got = sorted(map(tuple, S.grouped(df, slip=3).collect()))
    want = expected(counts)
    assert got == want and sum(x[1] is not None for x in want) > 10 and any(x[1] not in (None, x[2]) for x in want)


@pytest.mark.parametrize("reach", [3, 4, 9])
def test_reach_changes_groups_alone(spark, reach):
    r = random.Random(reach)
    n = {"".join(r.choices("ab", k=r.randrange(6, 12))): r.randrange(5, 900) for _ in range(500)}
    near = S.near_words(spark.createDataFrame(list(n.items()), "word string, n long"), reach=reach, part=60)
    want = {}
    for w in n:
        if own := [v for v in edits(w, "ab") if v in n]:
            best = min(own, key=lambda v: (-n[v], v))
            want[w] = (len(own), n[best], best)
    assert {x["word"]: (x["n_near"], x["form_n"], x["form"]) for x in near.collect()} == want


def test_automaton():
    r = random.Random(8)
    words = sorted({"".join(r.choices("abc", k=r.randrange(1, 7))) for _ in range(300)})
    a = S.Automaton(words)
    for i, w in enumerate(words):
        assert a.follow(w)[1] == i
    for w in [*words, "zzz", "abcabc"]:
        for half in range(len(w) + 1):
            got = a.one_error(w[:half], w[half:])
            assert len(got) == len(set(got))
            assert {words[x] for x in got} == {v for v in words if v[:half] == w[:half] and v[half:] in edits(w[half:], "abc")}
    live = {id(e) for e in a.edges if e}
    assert len(live) < len({w[:i] for w in words for i in range(7)})  # states are shared


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.grouped(df).count() == 0
    once = spark.createDataFrame([(1, "single words only")], "doc_id long, text string")
    assert S.grouped(once).count() == 0


def test_query_on_given_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(x) for x in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, S.op11_spelling_variants(spark, sf).collect())) == expected(counted(docs))
