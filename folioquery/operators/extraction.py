"""Field extraction: pages to candidates, candidates to one value for each field.

A candidate is a row (doc_id, field, page, value, normalized, start, end, confidence, method, turn, evidence). All windows are by document
(and field), so one shuffle by doc_id serves regions, agreement and ranking; all patterns of all fields run in one projection over each page.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import Catalog
from ..functions import text as T
from ..functions import vocabulary as V
from ..sources.tables import order_facts, order_pages

C = Catalog()
AS_OF = "2026-06-30"


def with_markers(pages: DataFrame) -> DataFrame:
    """pages(text) with read_at and order_at, where references and body begin."""
    return pages.withColumn("read_at", T.first_at(F.col("text"), V.READ_MARKER)).withColumn("order_at", T.first_at(F.col("text"), V.ORDER_MARKER))


def with_carried(rows: DataFrame) -> DataFrame:
    """rows(doc_id, page, read_at, order_at), one or more for each page, with carried, the region that the page before ended in."""
    ends = F.when(F.col("order_at").isNotNull(), "body").when(F.col("read_at").isNotNull(), "references")
    before = Window.partitionBy("doc_id").orderBy("page").rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("carried", F.coalesce(F.last(ends, ignorenulls=True).over(before), F.lit("header")))


def with_regions(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, text) with read_at, order_at and carried, the region that the page before ended in."""
    return with_carried(with_markers(pages))


def region(start: Column) -> Column:
    return F.when(start >= F.col("order_at"), "body").when(start >= F.col("read_at"), "references").otherwise(F.col("carried"))


def page_weight(page: Column) -> Column:
    return F.when(page == 1, 1.0).when(page == 2, 0.75).otherwise(0.5)


def region_weight(field: str, where: Column) -> Column:
    return reduce(lambda c, rw: c.when(where == rw[0], rw[1]), V.REGION_WEIGHTS[field].items(), F.when(F.lit(False), 1.0))


@dataclass
class Rule:
    """How matches of one kind become candidates; marked is the page's text with marks around them. The other columns are over a row of page, found and part_1 to part_3,
    the first groups of pattern (as many as parts); a null normalized drops the match. base, method and value may use normalized too."""

    field: str
    marked: Column
    normalized: Column
    base: Column
    method: Column
    pattern: str = ""
    parts: int = 0
    weighted: bool = True
    value: Column | None = None
    first_turn: int = 0
    if_open: bool = False


def _marked(pattern: str, needle: str | None = None, skip: str | None = None) -> Column:
    """Matches on a page; needle is a text that every match holds, which spares the pattern on other pages."""
    found = T.marked(F.col("plain"), pattern, skip)
    return found if needle is None else F.when(F.contains("text", F.lit(needle)), found)


def numbers() -> list[Rule]:
    """Order numbers; a bare order number counts on a page only while the document has no candidate yet, see with_open."""
    raw = F.concat("part_1", "part_2")
    series = F.when(raw != "", F.coalesce(T.looked_up(F.upper(raw), V.SERIES), raw))
    named = F.when(raw == "", F.concat(F.lit("G.O. No."), "part_3")).otherwise(F.concat(F.lit("G.O.("), series, F.lit(") No."), "part_3"))
    base, method = F.when(raw == "", 0.86).otherwise(0.98), F.when(raw == "", "GO_NUMBER_FULL").otherwise("GO_NUMBER_FULL+series")
    return [
        Rule("go_number", _marked(V.GO_NUMBER), named, base, method, V.GO_NUMBER, 3),
        Rule("go_number", _marked(V.ORDER_NUMBER), F.concat(F.lit("Order No."), "part_1"), F.lit(0.55), F.lit("ORDER_NUMBER_LOOSE"), V.ORDER_NUMBER, 1, if_open=True),
    ]


def with_open(rows: DataFrame, full: Column, loose: Column) -> DataFrame:
    """rows(doc_id, page) with open: neither a full number up to this page nor a bare one before it."""
    so_far = Window.partitionBy("doc_id").orderBy("page")
    any_full, any_loose = F.max(full).over(so_far), F.max(loose).over(so_far.rangeBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("open", ~any_full & ~F.coalesce(any_loose, F.lit(False)))


def dates(as_of: str = AS_OF) -> list[Rule]:
    out = []
    for i, (name, rx, base) in enumerate(V.DATE_PATTERNS):
        month = T.looked_up(F.lower("part_2"), V.MONTHS) if "TEXTUAL" in name else F.col("part_2").cast("int")
        day = T.built_date(F.col("part_1").cast("int"), month, F.col("part_3").cast("int"))
        out.append(Rule("go_date", _marked(rx), F.when(day <= F.lit(as_of).cast("date"), day.cast("string")), F.lit(base), F.lit(name), rx, 3, first_turn=1000 * i))
    return out


def departments() -> list[Rule]:
    name = F.col("normalized")
    heading = F.nullif(T.department(F.col("part_1")), F.lit(""))
    inline = T.let(T.department(F.col("part_1")), lambda n: F.when(T.is_department(n), n))
    shown = T.collapsed(F.col("found"))
    return [
        Rule("department", _marked(V.DEPARTMENT_HEADING, "DEPARTMENT"), heading, F.when(T.is_department(name), 0.98).otherwise(0.80), F.lit("DEPARTMENT_HEADING"), V.DEPARTMENT_HEADING, 1, value=shown),
        Rule("department", _marked(V.DEPARTMENT_IN_ABSTRACT, "Department", V.NO_DEPARTMENT), inline, F.lit(0.90), F.lit("DEPARTMENT_IN_ABSTRACT"), V.DEPARTMENT_IN_ABSTRACT, 1, value=shown, first_turn=1000),
    ]


def subjects() -> list[Rule]:
    """The abstract, or the paragraph that ends with the issuing formula; weighted by page alone."""
    text, body = F.col("plain"), T.stripped(T.collapsed(F.col("found")))
    empty = F.col("abstract").rlike(r"^[\s\-–—]*$")
    abstract = F.when(~empty, T.marked_at(text, F.position("abstract", text) - 1, F.length("abstract")))
    head = F.substring(text, F.lit(1), F.col("issued_at"))
    end = F.col("issued_at") + F.length(F.regexp_extract(text, V.ORDERS_ISSUED, 0))
    para = F.when(F.contains(head, F.lit("\n\n")), F.length(head) - F.length(F.substring_index(head, "\n\n", -1))).otherwise(0)
    issued = F.when(empty & F.col("issued_at").isNotNull(), T.marked_at(text, para, end - para))
    weighed = lambda base: F.lit(base) * page_weight(F.col("page"))
    return [
        Rule("subject", abstract, body, weighed(0.95), F.lit("ABSTRACT_BLOCK"), weighted=False, value=body),
        Rule("subject", issued, F.when(F.length(body).between(15, 1200), body), weighed(0.72), F.lit("ORDERS_ISSUED_TAIL"), weighted=False, value=body),
    ]


def budgets() -> list[Rule]:
    amount = F.replace(F.col("part_1"), F.lit(","), F.lit("")).try_cast("double")
    unit = F.lower("part_2")
    total = amount * F.coalesce(T.looked_up(unit, V.UNITS), F.lit(1))
    bonus = F.least(F.length(total.cast("decimal(38,0)").cast("string")) / 12.0, F.lit(0.25))
    method = F.concat(F.lit("MONEY_NUMERIC"), F.when(unit != "", F.concat(F.lit("+"), unit)).otherwise(""))
    shown = F.when(total > 0, F.format_string("%.2f", total))
    return [Rule("budget", _marked(V.MONEY), shown, F.least(0.70 + bonus, F.lit(0.95)), method, V.MONEY, 2, weighted=False)]


def _district_pattern() -> str:
    names = sorted([*V.DISTRICTS, *V.DISTRICT_ALIASES], key=len, reverse=True)
    first = "".join(sorted({n[0].lower() for n in names}))  # looked at before the names are tried one by one
    return rf"(?i)\b(?=[{first}])({'|'.join(names)})\b(\s+District)?"


def districts() -> list[Rule]:
    """Mentions; at_first_mention makes one candidate of those of a district. Until then confidence is what the word District adds."""
    rx = _district_pattern()
    return [Rule("district", _marked(rx), T.district(F.col("part_1")), F.when(F.col("part_2") != "", 0.10).otherwise(0.0), F.lit("DISTRICT_GAZETTEER"), rx, 2, weighted=False)]


def at_first_mention(rows: DataFrame) -> DataFrame:
    """One candidate for each district, at its first mention; mentions and the word District add confidence."""
    by = Window.partitionBy("doc_id", "field", "normalized")
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(by)).withColumn("_first", F.row_number().over(by.orderBy("page", "start"))).where("field <> 'district' or _first = 1")
    raised = F.round(F.least(0.70 + (F.least((F.col("_n") - 1) * 0.05, F.lit(0.15)) + F.col("confidence")), F.lit(0.95)), 4)
    return rows.withColumn("confidence", F.when(F.col("field") == "district", raised).otherwise(F.col("confidence"))).drop("_n", "_first")


def schemes() -> list[Rule]:
    name = F.regexp_replace(F.trim(F.concat("part_1", "part_2")), r"(?i)^((?:the|under|of|and|for)\s+)+", "")
    keyword = name.rlike(V.SCHEME_KEYWORD)
    shown = F.when(F.length(name) >= 6, T.collapsed(name))
    return [Rule("scheme_name", _marked(V.SCHEME), shown, F.when(keyword, 0.80).otherwise(0.60), F.when(keyword, "SCHEME_NAME+keyword").otherwise("SCHEME_NAME+quoted"), V.SCHEME, 2, weighted=False, value=name)]


EXTRACTORS = {"go_number": numbers, "go_date": dates, "department": departments, "subject": subjects, "budget": budgets, "district": districts, "scheme_name": schemes}


def candidates(pages: DataFrame, fields: tuple[str, ...] = V.ALL_FIELDS) -> DataFrame:
    """Candidates of the fields, from one pass over pages(doc_id, page, text).

    All that needs a text is done before its document's pages are put in order, so that texts are neither moved nor sorted. Each page has a row without a match too,
    which brings its markers to the pages after it.
    """
    rules = [r for f in fields for r in EXTRACTORS[f]()]
    text, plain = F.col("text"), F.col("plain")
    by_rule = lambda of: reduce(lambda c, kr: c if (x := of(kr[1])) is None else c.when(F.col("rule") == kr[0], x), enumerate(rules), F.when(F.lit(False), None))
    is_one = lambda those: F.col("rule").isin([k for k, r in enumerate(rules) if those(r)])
    read = with_markers(pages).withColumn("plain", T.unmarked(text))
    if "subject" in fields:
        read = read.withColumn("abstract", F.regexp_extract(plain, V.ABSTRACT_BLOCK, 1)).withColumn("issued_at", T.first_at(plain, V.ORDERS_ISSUED))
    one = lambda k, marked: F.struct(F.lit(k).alias("rule"), marked.alias("marked"))
    rows = read.select("doc_id", "page", "text", "read_at", "order_at", F.inline(F.array(one(-1, F.lit(T.NONE_MARKED)), *[one(k, r.marked) for k, r in enumerate(rules)])))
    rows = T.found_in(rows, "marked").drop("marked").withColumn("end", F.col("start") + F.length("found"))
    rows = rows.withColumn("found", F.when(T.is_odd(text), F.substring(text, F.col("start") + 1, F.length("found"))).otherwise(F.col("found")))
    rows = rows.withColumns({f"part_{i}": by_rule(lambda r, i=i: F.regexp_extract("found", r.pattern, i) if i <= r.parts else None) for i in (1, 2, 3)})
    rows = rows.withColumn("normalized", by_rule(lambda r: r.normalized)).withColumns({
        "field": by_rule(lambda r: F.lit(r.field)), "value": F.trim(by_rule(lambda r: F.col("found") if r.value is None else r.value)), "base": by_rule(lambda r: r.base), "method": by_rule(lambda r: r.method),
        "turn": F.col("turn") + by_rule(lambda r: F.lit(r.first_turn)), "evidence": T.evidence(text, F.col("start"), F.col("end")),
    })
    known = with_carried(rows.drop("text", "found", "part_1", "part_2", "part_3"))
    kept = F.col("normalized").isNotNull()
    if any(r.if_open for r in rules):
        known = with_open(known, is_one(lambda r: r.field == "go_number" and not r.if_open), is_one(lambda r: r.if_open))
        kept = kept & (~is_one(lambda r: r.if_open) | F.col("open"))
    known = known.where(kept).withColumn("where", region(F.col("start")))
    by_region = reduce(lambda c, f: c.when(F.col("field") == f, region_weight(f, F.col("where"))), V.REGION_WEIGHTS, F.when(F.lit(False), 1.0))
    weighted = is_one(lambda r: r.weighted)
    out = known.select(
        "doc_id", "field", "page", "value", "normalized", "start", "end", F.round(F.when(weighted, F.col("base") * (page_weight(F.col("page")) * by_region)).otherwise(F.col("base")), 4).alias("confidence"),
        F.when(weighted, F.concat_ws("@", "method", "where")).otherwise(F.col("method")).alias("method"), "turn", "evidence",
    )
    return at_first_mention(out) if "district" in fields else out


def adjusted(own: Column, n: Column, rival: Column) -> Column:
    """A confidence raised by n candidates of the same value, lowered by how near the best other value comes."""
    raised = F.when(n > 1, F.least(own + F.least((n - 1) * 0.02, F.lit(0.06)), F.lit(0.99))).otherwise(own)
    return F.round(F.when((rival > 0) & (own > 0), raised * (1.0 - 0.15 * F.least(rival / own, F.lit(1.0)))).otherwise(raised), 4)


def ranked(rows: DataFrame) -> DataFrame:
    """Candidates with final, the confidence that ranks them, and place, 1 for the winner of its field.

    Agreement is applied twice, to candidates and when they are ranked. As it keeps the order of a value's candidates, the second round needs only the best of each value
    after the first, so one list of values for each field serves both.
    """
    by, same = Window.partitionBy("doc_id", "field"), Window.partitionBy("doc_id", "field", "normalized")
    out = rows.withColumn("_n", F.count(F.lit(1)).over(same)).withColumn("_best", F.max("confidence").over(same))
    out = out.withColumn("_one", F.sort_array(F.collect_set(F.struct(F.col("_best").alias("best"), F.col("_n").alias("n"), "normalized")).over(by), asc=False))

    def rival(values: Column, value: Column) -> Column:
        """The best of the other values, of values with the best first."""
        first, second = F.get(values, F.lit(0)), F.get(values, F.lit(1))
        return F.coalesce(F.when(first["normalized"] == value, second["best"]).otherwise(first["best"]), F.lit(0.0))

    once = F.transform("_one", lambda x: F.struct(adjusted(x["best"], x["n"], rival(F.col("_one"), x["normalized"])).alias("best"), x["normalized"].alias("normalized")))
    several = F.when(F.size("_one") > 1, F.sort_array(once, asc=False))  # a value alone has no rival in either round
    out = out.withColumn("_two", several).withColumn("confidence", adjusted(F.col("confidence"), F.col("_n"), rival(F.col("_one"), F.col("normalized"))))
    out = out.withColumn("final", adjusted(F.col("confidence"), F.col("_n"), rival(F.col("_two"), F.col("normalized")))).drop("_n", "_best", "_one", "_two")
    order = Window.partitionBy("doc_id", "field").orderBy(F.desc("final"), "page", "start", "turn")
    return out.withColumn("place", F.row_number().over(order))


def winners(rows: DataFrame) -> DataFrame:
    return ranked(rows).where("place = 1")


def losers(rows: DataFrame) -> DataFrame:
    """Candidates whose value is not that of the winner."""
    return without_winner(ranked(rows))


def without_winner(ranked_rows: DataFrame) -> DataFrame:
    won = F.first("normalized").over(Window.partitionBy("doc_id", "field").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked_rows.withColumn("_won", won).where(F.col("normalized") != F.col("_won")).drop("_won")


def _facts_sql() -> str:
    pick = lambda values: f"[{', '.join(repr(v) for v in values)}][o_orderkey % {len(values)} + 1]"
    return f"""facts AS (SELECT o_orderkey AS doc_id, CAST(o_orderkey % 90000 + 100 AS VARCHAR) AS number, o_orderkey % 5 AS form, CAST(o_orderdate AS DATE) AS dated,
  {pick(V.DEPARTMENTS)} AS department, {pick(V.DISTRICTS)} AS district, greatest(CAST(floor(o_totalprice) AS BIGINT), 1) AS amount, {pick(V.SCHEMES)} AS scheme FROM orders)"""


FACTS = _facts_sql()
NUMBER = "CASE form WHEN 0 THEN 'G.O.(Ms) No.' WHEN 1 THEN 'G.O. No.' WHEN 2 THEN 'G.O.(Rt) No.' WHEN 3 THEN 'Order No.' ELSE 'G.O.(D) No.' END || number"


def _best(spark: SparkSession, sf_dir: str, field: str) -> DataFrame:
    return winners(candidates(order_pages(order_facts(spark, sf_dir)), (field,))).select("doc_id", "normalized", "page")


@C.query(f"WITH {FACTS} SELECT doc_id, {NUMBER} AS normalized, 1 AS page FROM facts")
def order_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, "go_number")


@C.query(f"WITH {FACTS} SELECT doc_id, CAST(dated AS VARCHAR) AS normalized, 1 AS page FROM facts")
def order_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, "go_date")


@C.query(f"WITH {FACTS} SELECT doc_id, department AS normalized, 1 AS page FROM facts")
def order_department(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, "department")


@C.query(f"WITH {FACTS} SELECT doc_id, department || ' Department - Works of the year - Orders issued.' AS normalized, 1 AS page FROM facts")
def order_subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, "subject")


@C.query(f"WITH {FACTS} SELECT doc_id, CAST(amount * 100000 AS VARCHAR) || '.00' AS normalized, 1 AS page FROM facts")
def order_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, "budget")


@C.query(f"WITH {FACTS} SELECT doc_id, district AS normalized, 1 AS page FROM facts")
def order_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, "district")


@C.query(f"WITH {FACTS} SELECT doc_id, scheme || ' Scheme' AS normalized, 1 AS page FROM facts")
def order_scheme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir, "scheme_name")


_BASE = "CASE form WHEN 1 THEN 0.86::DOUBLE ELSE 0.98::DOUBLE END"


@C.query(
    f"""WITH {FACTS}, one AS (SELECT doc_id, form, {_BASE} AS own, round(0.98::DOUBLE * 0.22::DOUBLE, 4) AS rival FROM facts),
two AS (SELECT doc_id, form, round(own * (1 - 0.15::DOUBLE * least(rival / own, 1)), 4) AS own, round(rival * (1 - 0.15::DOUBLE), 4) AS rival FROM one)
SELECT doc_id, CASE WHEN form = 3 THEN 0.55::DOUBLE ELSE round(own * (1 - 0.15::DOUBLE * least(rival / own, 1)), 4) END AS final,
  CASE form WHEN 3 THEN 'ORDER_NUMBER_LOOSE@header' WHEN 1 THEN 'GO_NUMBER_FULL@header' ELSE 'GO_NUMBER_FULL+series@header' END AS method FROM two"""
)
def order_number_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement applied twice to winners: once to candidates, once when ranking them."""
    return winners(candidates(order_pages(order_facts(spark, sf_dir)), ("go_number",))).select("doc_id", "final", "method")


@C.query(
    f"""WITH {FACTS} SELECT doc_id, 'go_number' AS field, 'G.O.(Ms) No.11' AS normalized, 1 AS page, round(round(0.98::DOUBLE * 0.22::DOUBLE, 4) * (1 - 0.15::DOUBLE), 4) AS confidence FROM facts WHERE form <> 3
UNION ALL SELECT doc_id, 'go_date', '1990-01-04', 1, round((round(0.97::DOUBLE * 0.22::DOUBLE, 4) + 0.02::DOUBLE) * (1 - 0.15::DOUBLE), 4) FROM facts WHERE form <> 3
UNION ALL SELECT doc_id, 'go_date', '1990-01-04', 1, round((round(0.62::DOUBLE * 0.22::DOUBLE, 4) + 0.02::DOUBLE) * (1 - 0.15::DOUBLE), 4) FROM facts WHERE form <> 3"""
)
def order_losers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that lost: numbers and dates of the orders cited."""
    rows = candidates(order_pages(order_facts(spark, sf_dir)), ("go_number", "go_date"))
    return losers(rows).select("doc_id", "field", "normalized", "page", "confidence")


@C.query(
    f"""WITH {FACTS} SELECT doc_id, field, CAST(CASE WHEN form = 3 AND field = 'go_number' THEN 1 WHEN field = 'go_number' THEN 2 WHEN form = 3 THEN 2 ELSE 4 END AS BIGINT) AS n
FROM facts, (VALUES ('go_number'), ('go_date')) f(field)"""
)
def order_candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates(order_pages(order_facts(spark, sf_dir)), ("go_number", "go_date"))
    return rows.groupBy("doc_id", "field").agg(F.count(F.lit(1)).alias("n"))


@C.query(
    f"""WITH {FACTS} SELECT doc_id, {NUMBER} AS go_number, CAST(dated AS VARCHAR) AS go_date, department, district, scheme || ' Scheme' AS scheme_name, CAST(amount * 100000 AS VARCHAR) || '.00' AS budget,
CAST(0 AS BIGINT) AS n_missing_core FROM facts"""
)
def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of each order as one wide record."""
    best = winners(candidates(order_pages(order_facts(spark, sf_dir))))
    wide = best.groupBy("doc_id").pivot("field", list(V.ALL_FIELDS)).agg(F.first("normalized"))
    missing = sum(F.col(f).isNull().cast("bigint") for f in V.CORE_FIELDS)
    return wide.withColumn("n_missing_core", missing).drop("subject")


@C.query(f"WITH {FACTS} SELECT doc_id, page, CASE page WHEN 1 THEN 'header' ELSE 'body' END AS carried, page = 1 AS has_read, page = 1 AS has_order FROM facts, (VALUES (1), (2)) p(page)")
def order_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = with_regions(order_pages(order_facts(spark, sf_dir)))
    return out.select("doc_id", "page", "carried", F.col("read_at").isNotNull().alias("has_read"), F.col("order_at").isNotNull().alias("has_order"))


QUERIES, ORACLE_SQL = C.queries, C.oracle_sql
