from datetime import datetime

import pytest
from pyspark.sql import functions as F

from folioquery.operators import operations as O
from folioquery.operators import records as R
from folioquery.operators import workbench as W


def test_clones_take_the_first_free_name(spark):
    have = ["a", "a (clone)", "a (clone 2)", "b", "b (clone 2)", "c", "c (clone x)", "a (clone)", "a (clone) (clone)"]
    frame = spark.createDataFrame([(n,) for n in have], "name string")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("a (clone)",)], "name string")
    out = {r["name"]: r["clone"] for r in O.cloned(wanted, frame).collect()}
    assert out == {"a": "a (clone 3)", "b": "b (clone)", "c": "c (clone)", "a (clone)": "a (clone) (clone 2)"}


def test_newest_ocr_run_of_a_page_counts(spark):
    pages = spark.createDataFrame([(1, 1, "x"), (1, 2, "y" * 90), (2, 1, "z")], "doc_id long, page long, text string")
    ocr = spark.createDataFrame([(1, 1, 1, "old text", 0.9), (1, 1, 2, "new text", 0.8), (2, 1, 1, "sure", 0.9), (2, 1, 2, "unsure", 0.1)], "doc_id long, page long, run int, text string, word_confidence double")
    out = {(r["doc_id"], r["page"]): (r["text"], r["improved"]) for r in R.ocr_merged(pages, ocr).collect()}
    assert out == {(1, 1): ("new text", True), (1, 2): ("y" * 90, False), (2, 1): ("z", False)}


def test_annotation_files(spark, tmp_path):
    good, bad, none = (str(tmp_path / n) for n in ("good.csv", "bad.csv", "none.csv"))
    open(good, "w", encoding="utf-8-sig").write('file_name, go_number\n a.pdf ,"1, ""x"""\nb.pdf,\n')
    open(bad, "w", encoding="utf-8").write("file_name,go_number\na.pdf,1\n ,2\nc.pdf,3\n,4\n")
    open(none, "w", encoding="utf-8").write("name\nx\n")
    assert [tuple(r) for r in W.read_annotations(spark, good).orderBy("file_name").collect()] == [("a.pdf", '1, "x"'), ("b.pdf", "")]
    with pytest.raises(ValueError, match=r"lines \[3, 5\]"):
        W.read_annotations(spark, bad)
    several = tmp_path / "several"
    several.mkdir()
    for n, text in (("a.csv", 'file_name,go_number\nx,1\ny,2\n'), ("b.csv", 'file_name,go_number\nx,"1\n2\n3"\n,4\n"",5\n'), ("c.csv", 'file_name,go_number\n ,1\n')):
        (several / n).write_text(text)
    with pytest.raises(ValueError, match=r"b.csv lines \[5, 6\]; c.csv lines \[2\]"):
        W.read_annotations(spark, str(several))
    with pytest.raises(ValueError, match="no column"):
        W.read_annotations(spark, none)


def test_unresolved_names_give_nothing(spark):
    regions = spark.createDataFrame([(0, "S0"), (1, "S1")], "r_regionkey int, r_name string")
    nations = spark.createDataFrame([(5, "D5", 0)], "n_nationkey int, n_name string, n_regionkey int")
    active = spark.createDataFrame([(1, 0, "Finance"), (2, 1, "Finance")], "id long, region int, department string")
    requests = spark.createDataFrame([("all", None, None), ("s", "S1", None), ("d", "S1", "D5"), ("no s", "X", None), ("no d", None, "X"), ("no s d", "X", "D5")], "request string, state_name string, district_name string")
    by_district = spark.createDataFrame([(5, 1)], "district int, id long")
    got = sorted(tuple(r) for r in W.in_scope(requests, regions, nations, active, by_district).collect())
    assert got == [("all", 1), ("all", 2), ("d", 1), ("s", 2)]
    assert W.in_scope(requests, regions, nations, active, by_district, ("health",)).count() == 0


def test_all_fourteen_causes_occur(spark):
    out = O.exception_causes(spark, "/root/testdata/sf0.001").select("root_cause").distinct().collect()
    assert len(out) == 14


def test_entries_within_jobs(spark):
    """Jobs of any length against a count of every pair, with entries that share a time and times that are null."""
    minutes = [0, 0, 0, 59, 60, 61, 61, 359, 360, 1500, 1860]
    log = spark.createDataFrame([(m, int(i % 3 == 0)) for i, m in enumerate(minutes)] + [(None, 1)], "m int, e int")
    stamp = F.expr("timestampadd(MINUTE, m, TIMESTAMP '2026-01-01 00:00:00')")
    summed = log.select(stamp.alias("ts"), "e").groupBy("ts").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("errors"))
    ends = [0, 1, 60, 61, 362, 1499, 1860, 5000]
    out = O.entries_until(summed, spark.createDataFrame([(m,) for m in ends], "m int").select(stamp.alias("ts")))
    got = {int((r["ts"] - datetime(2026, 1, 1)).total_seconds() // 60): (r["n"], r["errors"], r["n_here"]) for r in out.collect()}
    assert set(got) == set(ends) | set(minutes)
    for m, (n, errors, here) in got.items():
        upto = [i for i, x in enumerate(minutes) if x <= m]
        assert (n, errors, here) == (len(upto), sum(i % 3 == 0 for i in upto), minutes.count(m))
