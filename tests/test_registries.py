import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from folioquery.operators import exchange as X
from folioquery.operators import registries as R
from folioquery.streaming.store import Store, hashed
from folioquery.streaming.streams import summed


@pytest.mark.parametrize("span", [7, 10_000])
def test_as_of_takes_the_version_before(spark, span):
    r = random.Random(span)
    versions = {(r.choice("abc"), r.randrange(300)): r.random() < 0.5 for _ in range(120)}
    rows = [(i, r.choice("abcd"), r.randrange(320), "x") for i in range(400)]
    want = []
    for i, k, at, extra in rows:
        before = [(t, v) for (key, t), v in versions.items() if key == k and t < at]
        want.append((i, k, at, extra, max(before)[1] if before else None))
    out = R.as_of(spark.createDataFrame(rows, "id long, k string, at long, note string"), spark.createDataFrame([(*key, v) for key, v in versions.items()], "k string, at long, open boolean"), "k", "at", "open", span)
    assert sorted(map(tuple, out.collect())) == want


def test_refused_edits(spark):
    acts = [("move", True), ("create", False), ("create", True), ("create", True), ("move", False), ("move", True), ("restore", True), ("retire", False), ("move", True), ("retire", True), ("rename", False), ("restore", False), ("restore", True)]
    df = spark.createDataFrame([(5, i, a, 10 + i, o) for i, (a, o) in enumerate(acts)][::-1], "entry long, edit_id long, action string, department long, open boolean")
    out = [(x["outcome"], x["version"], x["active"], x["department"]) for x in R.guarded_edits(df).orderBy("edit_id").collect()]
    assert out == [
        ("missing", 0, False, None), ("closed department", 0, False, None), ("ok", 1, True, 12), ("exists", 1, True, 12), ("closed department", 1, True, 12), ("ok", 2, True, 15), ("active", 2, True, 15),
        ("ok", 3, False, 15), ("retired", 3, False, 15), ("retired", 3, False, 15), ("ok", 4, False, 15), ("closed department", 4, False, 15), ("ok", 5, True, 22),
    ]


def test_declared_schema_over_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a"), (2, None)], "ID long, name string").write.parquet(f"{path}/v=1")
    spark.createDataFrame([(3, "b", "7", None), (4, "c", "seven", "Low"), (5, None, "x", "")], "id long, name string, size string, level string").write.parquet(f"{path}/v=2")
    schema = StructType.fromDDL("id long NOT NULL, name string NOT NULL, size int, level string NOT NULL")
    out = sorted(map(tuple, X.read_versions(spark, path, schema, {"level": "Normal"}).collect()))
    assert out == [(1, "a", None, "Normal", []), (2, None, None, "Normal", ["name"]), (3, "b", 7, "Normal", []), (4, "c", None, "Low", ["size"]), (5, None, None, "", ["name", "size"])]


def test_json_round_trip_and_manifest(spark, tmp_path):
    schema = "id long, at date, inner struct<a:string,b:array<double>>, m map<string,string>"
    rows = spark.sql("SELECT 1L id, DATE '2024-02-29' at, named_struct('a', 'x\"\\n', 'b', array(1.5D, NULL)) inner, map('k', 'ü') m UNION ALL SELECT 2L, NULL, NULL, NULL").to(StructType.fromDDL(schema))
    X.export_json(rows, str(tmp_path / "e"))
    back = X.import_json(spark, str(tmp_path / "e"), schema)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, rows.collect()))
    rows.limit(1).write.mode("append").json(str(tmp_path / "e/rows"))
    with pytest.raises(ValueError, match="manifest"):
        X.import_json(spark, str(tmp_path / "e"), schema)
    X.export_json(rows.limit(0), str(tmp_path / "none"))
    assert X.import_json(spark, str(tmp_path / "none"), schema).count() == 0


def test_kept_counts_equal_counts_anew(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.choice("st"), r.choice(["quality", "toxic"]), r.choice(["tp", "wrong", "missed", "hallucinated", "tn"])) for _ in range(300)]
    schema = "source string, field string, outcome string"
    store = Store(spark, str(tmp_path / "s"), "source string, field string, tp long, fp long, fn long, tn long", hashed(4, "source"))
    for number, part in enumerate((rows[:100], rows[100:110], rows[110:])):
        for _ in range(2 if number == 1 else 1):  # the second run comes twice
            R.merged_counts(store, spark.createDataFrame(part, schema), number)
    want = spark.createDataFrame(rows, schema).groupBy("source", "field").agg(*R.counters())
    assert sorted(map(tuple, store.rows().collect())) == sorted(map(tuple, want.collect()))
    assert summed(["source"], tp=F.sum)(store.rows().select("source", "tp"), store.rows().select("source", "tp")).count() == 2
