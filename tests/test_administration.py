"""Decisions, edits and clean-ups against plain loops, adapters by name, and lines of any length."""

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from folioquery.functions import vocabulary as V
from folioquery.operators import administration as A
from folioquery.operators import records as R


def test_decisions_equal_a_plain_fold(spark):
    rng = random.Random(5)
    lacks = {r: [f for f in ("subject", "go_date") if rng.random() < 0.6] for r in range(30)}
    log = []
    for i in range(600):
        r, action = rng.randrange(30), rng.choice(["correct", "correct", "approve", "reject"])
        name = rng.choice(["subject", "go_date", "district", "colour"]) if action == "correct" else None
        had = "0" if name in ("district", "subject", "go_date") and name not in lacks[r] else None
        log.append((i, r, action, rng.choice(["a", None, "b"]), name, str(rng.randrange(2)) if name else None, rng.choice([1, None]), rng.choice(["why", None]), rng.random() < 0.3, had, lacks[r]))
    frame = spark.createDataFrame(log, "event_id int, record int, action string, reviewer string, field string, value string, page int, reason string, override boolean, had string, lacks array<string>")
    got = {x["event_id"]: (x["verdict"], x["before"], x["after"]) for x in A.decided(frame.orderBy(F.rand(3))).collect()}
    held, status = {}, {}
    for i, r, action, who, name, value, page, reason, override, had, lack in log:
        if action == "correct" and name not in V.ALL_FIELDS:
            want = ("unknown field", None, None)
        elif who is None:
            want = ("no reviewer", None, None)
        elif action == "correct":
            was = held.get((r, name), had)
            if was is None and page is None:
                want = ("no page", None, None)
            elif was == value:
                want = ("unchanged", None, None)
            else:
                want, held[r, name] = ("done", was, value), value
        elif action == "approve" and any((r, f) not in held for f in lack) and not override:
            want = ("fields missing", None, None)
        elif action == "reject" and reason is None:
            want = ("no reason", None, None)
        else:
            to = "approved" if action == "approve" else "rejected"
            want, status[r] = ("done", status.get(r, "pending"), to), to
        assert got[i] == want, (i, want)
    assert {v for v, _, _ in got.values()} == {"unknown field", "no reviewer", "no page", "unchanged", "fields missing", "no reason", "done"}


def test_edits_equal_a_plain_fold(spark):
    rng = random.Random(6)
    log = [(i, rng.randrange(9), rng.choice(["create", "edit", "edit"]), rng.choice([*A.PRIORITY, "Urgent", None])) for i in range(120)]
    got = {x["event_id"]: (x["verdict"], x["before"], x["after"]) for x in A.edited(spark.createDataFrame(log, "event_id int, name int, action string, value string")).collect()}
    have = {}
    for i, name, action, value in log:
        if value not in A.PRIORITY:
            want = ("value not allowed", None, None)
        elif (action == "create") == (name in have):
            want = ("name exists" if action == "create" else "no such name", None, None)
        else:
            want, have[name] = ("done", have.get(name), value), value
        assert got[i] == want, (i, want)


def test_cleanup_keeps_what_is_still_used(spark):
    records = spark.createDataFrame([(1, 1, 10, "pending"), (2, 1, 11, "pending"), (3, 1, 12, "pending"), (4, 2, 10, "decided"), (5, 3, 13, "pending"), (6, 1, 14, "approved")], "record int, document int, extraction int, status string")
    fields = spark.createDataFrame([(r, f) for r in range(1, 7) for f in "ab"], "record int, field string")
    log = spark.createDataFrame([(1, 1), (2, 3), (3, None)], "entry int, record int")
    out = A.cleaned(records, fields, log, spark.createDataFrame([(x,) for x in range(10, 15)], "extraction int"))
    assert sorted(r["record"] for r in out["records"].collect()) == [3, 4, 5, 6]
    assert sorted({r["record"] for r in out["fields"].collect()}) == [3, 4, 5, 6]
    assert sorted((r["entry"], r["record"]) for r in out["log"].collect()) == [(1, None), (2, 3), (3, None)]
    assert sorted(r["extraction"] for r in out["extractions"].collect()) == [10, 12, 13, 14]
    assert [tuple(r) for r in out["audit"].collect()] == [(1, 3, "1,2")]
    again = A.cleaned(out["records"], out["fields"], out["log"], out["extractions"])
    assert again["audit"].count() == 0 and again["records"].count() == 4


def test_adapters_are_found_by_name():
    assert A.adapter("portal_listing") is A.portal_listing
    with pytest.raises(LookupError, match="generic_links, portal_listing"):
        A.adapter("other")


def test_table_lines_of_any_length(spark):
    lines = ["a  b  c", "a\tb\tc", "a b c", "a  b", " a  b  c ", "a  b c", "a\t\tb  c", "", "x" * 200000, "a  " + "x" * 200000 + "  b", "a  " * 50000]
    began = time.time()
    got = [r["t"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string").orderBy("i").select(F.col("t").rlike(V.TABLE_LINE).alias("t")).collect()]
    assert got == [True, True, False, False, True, False, True, False, False, True, True]
    assert time.time() - began < 20
    pages = spark.createDataFrame([(1, 1, "a  b  c\n" * 6), (2, 1, "a  b  c\n" * 5)], "doc_id int, page int, text string")
    assert {r["doc_id"]: r["table_heavy"] for r in R.category_flags(pages).collect()} == {1: True, 2: False}


def test_store_finds_contents_that_are_not_what_their_name_says(spark, tmp_path):
    folder, schema = str(tmp_path / "store"), "sha256 string, content binary"
    name = lambda b: hashlib.sha256(b).hexdigest()
    spark.createDataFrame([(name(b"a"), bytearray(b"a")), (name(b"b"), bytearray(b"damaged")), (name(b"z"), bytearray(b"never offered"))], schema).write.parquet(folder)
    offered = spark.createDataFrame([(name(b), bytearray(b)) for b in (b"a", b"b", b"c", b"c", b"")], schema)
    assert [tuple(A.store_once(offered, folder).first()) for _ in range(2)] == [(5, 2, 2, 1), (5, 0, 4, 1)]


def test_script_and_flags_come_from_one_pass_over_pages(spark):
    pages = spark.createDataFrame([(1, 1, "அ" * 9 + "a"), (1, 2, "ANNEXURE a \tb\tc annexure"), (2, 1, "a b\tc"), (2, 2, "அz. 9"), (3, 1, "Xannexure ANNEXURES annexure\n" + "a \tb  c\n" * 6), (3, 2, ""), (4, 1, "9 . 9")], "doc_id int, page int, text string")
    extracted = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count")).select("doc_id", F.lit(False).alias("needs_ocr"), F.lit(False).alias("ocr_applied"), "page_count")
    out = A.categorized(pages, extracted, extracted.select("doc_id", F.lit("Health").alias("department")))
    got = {r["doc_id"]: (r["language"], r["annexure_heavy"], r["table_heavy"]) for r in out.collect()}
    assert got == {1: ("mixed", True, False), 2: ("mixed", False, False), 3: ("english", False, True), 4: ("unknown", False, False)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 4  # extracted, registered, flags with script, departments; five with a pass for each
