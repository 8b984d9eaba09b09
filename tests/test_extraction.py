"""Facts about single texts that the generated orders do not show."""

from pyspark.sql import functions as F

from folioquery.functions import text as T
from folioquery.functions import vocabulary as V
from folioquery.functions import web as W
from folioquery.operators import extraction as X
from folioquery.operators import records as R
from folioquery.operators import web as D


def best(spark, *pages):
    rows = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(pages)], "doc_id int, page int, text string")
    return {r["field"]: r for r in X.winners(X.candidates(rows)).collect()}


HEAD = "GOVERNMENT\n\nABSTRACT\n\nHealth Department - Works - Orders issued.\n\n----\n\nHEALTH AND FAMILY WELFARE (EAP-II) DEPARTMENT\n\nG.O.(Ms) No.123      Dated: 15.03.2026\n\nRead:\n 1. G.O.(Ms) No.11, Dated: 04.01.2024.\n\nORDER:\n\n"


def test_header_beats_citation(spark):
    out = best(spark, HEAD + "A sum of Rs.12.50 crore in Kanyakumari District under the Integrated Urban Flood Management Scheme.")
    assert out["go_number"]["normalized"] == "G.O.(Ms) No.123" and out["go_date"]["normalized"] == "2026-03-15"
    assert out["department"]["normalized"] == "Health and Family Welfare" and out["budget"]["normalized"] == "125000000.00"
    assert out["district"]["normalized"] == "Kanniyakumari" and out["scheme_name"]["normalized"] == "Integrated Urban Flood Management Scheme"
    assert out["subject"]["normalized"] == "Health Department - Works - Orders issued." and "No.123" in out["go_number"]["evidence"]


def test_region_carries_to_the_next_page(spark):
    out = best(spark, "G.O.(Ms) No.300\n\nRead:\n 1. Letter.", " 2. G.O.(Rt) No.9999 Dated: 01.02.2003.")
    assert out["go_number"]["normalized"] == "G.O.(Ms) No.300"
    assert out["go_date"]["method"].endswith("@references")


def test_future_and_impossible_dates_and_empty_text(spark):
    assert "go_date" not in best(spark, "Dated: 15.03.2099 and 31.02.2020")
    assert best(spark, "") == {}
    assert best(spark, "Dated: 5th March 1999")["go_date"]["normalized"] == "1999-03-05"


def test_tail_paragraph_without_abstract(spark):
    out = best(spark, "Heading\n\nSchool buildings - repair of roofs - Orders issued.\n\nMore")
    assert out["subject"]["normalized"] == "School buildings - repair of roofs - Orders issued." and out["subject"]["method"] == "ORDERS_ISSUED_TAIL"


def test_spans_and_departments(spark):
    row = spark.range(1).select(T.spans(F.lit("ab12cd3ü45"), "[0-9]+").alias("s")).first()["s"]
    assert [tuple(x) for x in row] == [("12", 2, 4), ("3", 6, 7), ("45", 8, 10)]
    row = spark.range(1).select(T.spans(F.lit("\x01a\x01b\x02c7"), "[a-z\x01]+|7").alias("s")).first()["s"]
    assert [tuple(x) for x in row] == [("a", 1, 2), ("b", 3, 4), ("c", 5, 6), ("7", 6, 7)]
    cases = {"PUBLIC WORKS": "Public Works", "PUBLIC": "Public", "ENERGY (A-1) DEPARTMENT": "Energy", "SPACE AFFAIRS": "Space Affairs", " - ": "", "Finance & more": "Finance"}
    df = spark.createDataFrame(list(cases.items()), "raw string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", T.department(F.col("raw")).alias("got")).collect())


def test_policy_and_urls(spark):
    rows = [("https://a.tn.gov.in/x", True), ("http://tn.gov.in", True), ("https://news.gov.in/", False), ("https://evil-gov.in", False), ("ftp://a.gov.in", False), (None, False), ("https://USER@A.Gov.IN:8080/p", True)]
    df = spark.createDataFrame(rows, "url string, want boolean")
    assert all(r["want"] == r["got"] for r in df.select("want", W.approved(F.col("url"), ("tn.gov.in", "gov.in"), ("news.gov.in",)).alias("got")).collect())
    base = "https://h.in/a/b?x=1#f"
    want = {"c": "https://h.in/a/c", "/c": "https://h.in/c", "?y": "https://h.in/a/b?y", "//k.in/z": "https://k.in/z", "http://q/": "http://q/", "": base, "#g": "https://h.in/a/b?x=1#g"}
    df = spark.createDataFrame(list(want.items()), "href string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", W.resolved(F.lit(base), F.col("href")).alias("got")).collect())
    names = {("https://x.in/go/G.O.%20123%20of%202026", ""): "GO-123-2026.pdf", ("https://x.in/a/the file.pdf?q", ""): "the-file.pdf", ("https://x.in/", ""): "document.pdf"}
    df = spark.createDataFrame([(*k, v) for k, v in names.items()], "url string, text string, want string")
    assert all(r["want"] == r["got"] for r in df.select("want", W.file_name(F.col("url"), F.col("text")).alias("got")).collect())


def test_listing_by_header(spark):
    html = '<table><tr><th>Date</th><th>G.O. Number</th><th>Subject</th></tr><tr><td>1.2.2026</td><td><a href="/d/1.pdf">No &amp; 1</a></td><td>S</td></tr></table>'
    out = D.listing_rows(spark.createDataFrame([(1, html)], "page_id int, html string")).first()
    assert out["href"] == "/d/1.pdf" and out["link_text"] == "No & 1"
    assert {h["field"]: h["value"] for h in out["hints"]} == {"go_date": "1.2.2026", "go_number": "No & 1", "subject": "S"}


def test_quality_of_pages(spark):
    rows = spark.createDataFrame([(1, 1, "x" * 1200), (2, 1, ""), (3, 1, "x" * 70), (4, 1, "�" * 60 + "x" * 1140)], "doc_id int, page int, text string")
    out = {r["doc_id"]: (r["confidence"], r["needs_ocr"]) for r in R.quality(rows).collect()}
    assert out[1] == (1.0, False) and out[2] == (0.0, True) and out[3][1] and out[4] == (0.5, False)
    tables = spark.createDataFrame([(1, 1, "a  b  c\n" * 6), (2, 1, "a b c\n" * 9)], "doc_id int, page int, text string")
    assert {r["doc_id"]: r["table_heavy"] for r in R.category_flags(tables).collect()} == {1: True, 2: False}


def test_script(spark):
    df = spark.createDataFrame([("தமிழ் உரை",), ("plain english",), ("தமிழ் half",), ("123",)], "text string")
    first, second = T.script_counts(F.col("text"), r"\x{0B80}-\x{0BFF}")
    assert [r[0] for r in df.select(T.language(first, second, ("tamil", "english"))).collect()] == ["tamil", "english", "mixed", "unknown"]


def test_texts_are_read_before_pages_are_put_in_order(spark):
    rows = spark.createDataFrame([(1, 1, HEAD)], "doc_id int, page int, text string")
    plan = X.winners(X.candidates(rows)).select("doc_id", "field", "normalized")._jdf.queryExecution().optimizedPlan()

    def windows(node):
        below = [x for i in range(node.children().size()) for x in windows(node.children().apply(i))]
        return [node.output().mkString(" "), *below] if node.nodeName() == "Window" else below

    held = windows(plan)
    assert held and not [x for x in held if "text#" in x or "found#" in x]


def test_departments_are_the_same_where_runs_are_skipped(spark):
    words = ["Public Works", "DEPARTMENT", " Department", "Departments", "A", "(AB-1) ", "(1 x)", "\n", "\t", "  ", "9", ".", "é", "x", "Very Long Name of an Office " * 3, "G", "\x01", "\x02"]
    texts = spark.range(3000).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(20)), lambda i: F.get(F.array(*[F.lit(w) for w in words]), F.pmod(F.xxhash64("id", i), F.lit(len(words))).cast("int"))), "").alias("text"))
    plain = texts.select("text", T.unmarked(F.col("text")).alias("plain"))
    both = plain.select(*[T.marked(F.col("plain"), V.DEPARTMENT_IN_ABSTRACT, skip).alias(f"with_{k}") for k, skip in enumerate((None, V.NO_DEPARTMENT))])
    assert both.where("with_0 like '%\x01%'").count() > 300 and both.where("with_0 <> with_1").count() == 0


def test_marks_in_a_text_and_dates_of_any_length(spark):
    out = best(spark, "\x01G.O.(Ms) No.7\x02 Dated: 5.3.99\x02 Dated: 1 Foo 1999")
    assert out["go_number"]["normalized"] == "G.O.(Ms) No.7" and out["go_number"]["start"] == 1 and out["go_number"]["evidence"].startswith("\x01G.O.")
    assert out["go_date"]["normalized"] == "1999-03-05" and out["go_date"]["start"] == 16
