from pyspark.sql import functions as F

from folioquery.plans import reports as R


def test_stages_take_what_the_ones_before_let_through(spark):
    items = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate([("x", "y"), (None, "y"), (None, None), ("z", None), (None, "y2"), (None, "y3"), (None, "y4")])] + [(2, 9, None, None)], "source int, item int, first string, second string")
    done = R.staged(items, one=F.col("first"), two=F.col("second"))
    assert {x["item"]: (x["failed_at"], x["error"]) for x in done.collect()} == {0: ("one", "x"), 1: ("two", "y"), 2: (None, None), 3: ("one", "z"), 4: ("two", "y2"), 5: ("two", "y3"), 6: ("two", "y4"), 9: (None, None)}
    out = {(x["source"], x["stage"]): tuple(x)[2:] for x in R.stage_counts(done, "source", ("one", "two")).collect()}
    assert out == {(1, "one"): (7, 5, 2, "x; z"), (1, "two"): (5, 1, 4, "y; y2; y3"), (2, "one"): (1, 1, 0, ""), (2, "two"): (1, 1, 0, "")}


def test_fields_against_targets(spark):
    expected = spark.createDataFrame([(1, "go_number", "G.O.(Ms) No.5"), (2, "go_number", "G.O.(Ms) No.6"), (3, "go_number", "G.O.(Rt) No.7"), (1, "scheme_name", "a Scheme")], "doc_id long, field string, wanted string")
    found = spark.createDataFrame([(1, "go_number", "G.O. Ms No. 5"), (2, "go_number", "G.O.(Rt) No.6"), (1, "scheme_name", "A scheme"), (9, "go_number", "x")], "doc_id long, field string, value string")
    out = {x["field"]: tuple(x)[1:] for x in R.against_targets(found, expected).collect()}
    assert out == {"go_number": (3, 1, 1, 0.333333, 0.99, False), "scheme_name": (1, 1, 0, 1.0, 0.9, True)}
