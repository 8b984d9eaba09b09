import hashlib
import random
import re

from folioquery.llm import substring_dedup as S
from folioquery.llm.common import table


def expected(rows, window=13):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    order = [float("inf") if d is None else d for d, _ in rows]
    least = {}
    for w, d in zip(split, order):
        for i in range(len(w) - window + 1):
            run = tuple(w[i : i + window])
            least[run] = min(least.get(run, float("inf")), d)
    out = []
    for w, d, (doc, _) in zip(split, order, rows):
        gone = set()
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out.append((doc, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out, key=repr)


def test_against_brute_force(spark):
    r = random.Random(8)
    words = [f"w{i}" for i in range(400)] + ["a", "ü", "x" * 30, "W1"]
    make = lambda n: [r.choice(words) for _ in range(n)]
    passages = [make(n) for n in (12, 13, 14, 60, 200)]
    texts = ["", None, " \n", "one two", " ".join(["a"] * 40), " ".join(["a"] * 60), "a\tb\x0bc\x1cd e f"]
    for _ in range(60):
        parts = []
        for _ in range(r.randrange(1, 5)):
            parts += make(r.randrange(0, 40)) + (r.choice(passages) if r.random() < 0.6 else [])
        texts.append(r.choice([" ", "  ", "\n"]).join(parts))
    texts += [texts[10]] * 5 + [" ".join(make(30_000))] * 2
    rows = list(enumerate(texts)) + [(3, texts[12]), (None, texts[11]), (None, texts[13]), (2, texts[12])]
    r.shuffle(rows)
    df = spark.createDataFrame([(d, t, "c", 0) for d, t in rows], "doc_id long, text string, kept string, at int")
    for window in (13, 20):
        out = S.without_repeats(df, window, ("n_words", "n_removed", "kept", "spans")).collect()
        assert sorted(((x["doc_id"], x["n_words"], x["n_removed"], x["kept"]) for x in out), key=repr) == expected(rows, window)
        for x in out:
            assert sum(s["end"] - s["start"] for s in x["spans"]) == x["n_removed"] and all(s["end"] - s["start"] >= window for s in x["spans"])
    assert S.without_repeats(df.limit(0)).count() == 0


def test_hot_lines_and_passages(spark):
    """One line in unlike contexts, one passage and one text, each in a third of all documents and in every slice."""
    r = random.Random(4)
    some = lambda n: " ".join(f"w{r.randrange(3000)}" for _ in range(n))
    line, passage, text = some(19), some(80), some(50)
    rows = [(i, [f"{some(30)} {line} {some(30)}", f"{some(20)} {passage} {some(20)}", text][i % 3]) for i in range(1500)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    out = S.without_repeats(docs, outputs=("n_words", "n_removed", "kept")).collect()
    assert sorted(((x["doc_id"], x["n_words"], x["n_removed"], x["kept"]) for x in out), key=repr) == expected(rows)
    tasks = S.segments(S._named(docs)).where("n >= 0").groupBy("anchor").count().agg({"count": "max"}).first()[0]
    assert tasks <= 8 * S.HOT  # of 500 documents


def test_text_longer_than_a_slice(spark):
    r = random.Random(5)
    text = " ".join(f"w{r.randrange(9000)}" for _ in range(250_000))
    rows = [(1, text), (2, "start " + text[: len(text) // 2]), (3, text[-200:])]
    out = S.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), outputs=("n_words", "n_removed", "kept")).collect()
    assert sorted(((x["doc_id"], x["n_words"], x["n_removed"], x["kept"]) for x in out), key=repr) == expected(rows)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(x["doc_id"], x["text"]) for x in table(spark, sf, "documents").collect()]
    out = S.op5_substring_dedup(spark, sf).collect()
    want = [(d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, n, m, t in expected(rows)]
    assert sorted(((x["doc_id"], x["n_words"], x["n_removed"], x["kept_sha256"]) for x in out), key=repr) == sorted(want, key=repr)


def test_streams_do_not_depend_on_batches():
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(0)
    for segments in (1, 2, 5):
        anchor, segment, turn, at = (r.integers(0, n, 400) for n in (60, segments, 6, 10_000))
        order = np.lexsort((turn, segment, anchor))
        anchor, segment, turn, at = (x[order] for x in (anchor, segment, turn, at))
        rows = pa.table({"anchor": anchor, "segment": segment, "turn": turn, "k": turn, "at": at, "n": at % 9 + 1})
        least = lambda i: turn[(anchor == anchor[i]) & (segment == segment[i])].min()
        whole = {i for i in range(400) if turn[i] > least(i)}
        check = {i for i in range(400) if i not in whole and len(set(segment[anchor == anchor[i]])) > 1}
        want = sorted((int(at[i]), i in whole) for i in whole | check)
        runs = rows.rename_columns(["r1", "r2", "turn", "k", "at", "n"])
        for size in (1, 2, 3, 7, 50, 400):
            got = [x for b in S._compared(iter(rows.combine_chunks().to_batches(size))) for x in b.to_pylist()]
            assert sorted((x["at"], x["whole"]) for x in got) == want
            later = [x for b in S._later(iter(runs.combine_chunks().to_batches(size))) for x in b.to_pylist()]
            assert sorted(x["at"] for x in later) == sorted(int(at[i]) for i in whole)
            decided = rows.set_column(5, "n", pa.array(np.where(np.arange(400) % 7 == 0, -3, 0 * at))).set_column(4, "at", pa.array(np.where(np.arange(400) % 14 == 0, ~at, at)))
            got = [(x["at"], x["n"], x["whole"]) for b in S._compared(iter(decided.combine_chunks().to_batches(size))) for x in b.to_pylist()]
            assert sorted(got) == sorted((int(at[i]), 3, i % 14 != 0) for i in range(0, 400, 7))


def test_contexts_of_an_anchor_with_equal_short_hashes(spark):
    """Each two share the anchor of five words alone; the upper 32 bits of their segments' hashes are equal."""
    anchor = " w901 w984 w816 w344 w480 "
    pairs = [("w369 w669 w431 w550", "w291 w485 w515 w569"), ("w405 w587 w163 w330", "w194 w71 w341 w90")], [("w276 w863 w87 w95", "w132 w932 w811 w765"), ("w787 w371 w419 w464", "w960 w153 w762 w172")]
    for pair in pairs:
        docs = spark.createDataFrame([(i, before + anchor + after) for i, (before, after) in enumerate(pair)], "doc_id long, text string")
        found = S.segments(S._named(docs)).collect()
        assert len(found) == 2 and found[0]["anchor"] == found[1]["anchor"] and found[0]["segment"] != found[1]["segment"] and found[0]["segment"] >> 32 == found[1]["segment"] >> 32
        assert [x["n_removed"] for x in S.without_repeats(docs, outputs=("n_removed",)).collect()] == [0, 0]


def mirrored(a="a", b="b", n=1024):
    """Two words that powers of any odd base modulo 2**64 cannot tell apart: the Thue-Morse order of two letters, and its complement."""
    return tuple("".join((a, b)[(i.bit_count() + k) % 2] for i in range(n)) for k in (0, 1))


def test_words_that_cancel_are_told_apart(spark):
    one, two = mirrored()
    rest = " ".join(f"w{i}" for i in range(12))
    rows = [(1, f"{one} {rest}"), (2, f"{two} {rest}"), (3, f"{one} {rest} more")]
    out = S.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), outputs=("n_words", "n_removed", "kept")).collect()
    assert sorted((x["doc_id"], x["n_words"], x["n_removed"], x["kept"]) for x in out) == expected(rows)
