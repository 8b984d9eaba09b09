"""Text, value and vocabulary functions, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocabulary as V


def normalized(text: Column) -> Column:
    """Line ends as LF, blanks collapsed, none around line ends, one blank line at most, trimmed."""
    out = F.regexp_replace(text, "\r\n|\r|\f", "\n")
    for pattern, to in (("[ \t]+", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n"), (r"^\s+|\s+$", "")):
        out = F.regexp_replace(out, pattern, to)
    return out


def collapsed(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def stripped(text: Column, chars: str = r"\s\-–—") -> Column:
    return F.regexp_replace(text, f"^[{chars}]+|[{chars}]+$", "")


def folded(text: Column) -> Column:
    """Lower case, & as and, other signs as one blank; for vocabularies."""
    out = F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit("and")), "[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(out, " +", " "))


def compared(text: Column) -> Column:
    """Lower case, other signs as one blank, & too; for comparing annotations."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


_MARK, _END, _OTHER = "\x01", "\x02", "\x03"


def is_odd(text: Column) -> Column:
    """Whether a text holds a mark that marked sets."""
    return F.contains(text, F.lit(_MARK)) | F.contains(text, F.lit(_END))


def unmarked(text: Column) -> Column:
    """A text to search for matches: a mark in it counts as another control sign."""
    return F.when(is_odd(text), F.translate(text, _MARK + _END, _OTHER * 2)).otherwise(text)


def marked(text: Column, pattern: str, skip: str | None = None) -> Column:
    """An unmarked text with each match between marks, so that every second piece is one; the pattern must not match an empty string.

    skip is a pattern for stretches within which no match begins if none begins at their first character; where the pattern fails, they are passed over at once.
    """
    if skip is None:
        return F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}")
    both = F.regexp_replace(text, f"(?<match>{pattern})|(?<skip>{skip})", f"${{skip}}{_MARK}${{match}}{_END}")
    return F.replace(F.replace(both, F.lit(_MARK + _END), F.lit("")), F.lit(_END), F.lit(_MARK))


def marked_at(text: Column, start: Column, n: Column) -> Column:
    """An unmarked text with marks around n characters."""
    return F.concat(F.substring(text, F.lit(1), start), F.lit(_MARK), F.substring(text, start + 1, n), F.lit(_MARK))


#: Marks around nothing.
NONE_MARKED = _MARK * 2


def found_in(rows: DataFrame, column: str) -> DataFrame:
    """A row for each match in a column of marked texts: its place among them (turn, from 0), found and start. Generated code alone, no lambda over pieces."""
    pieces = rows.where(F.contains(column, F.lit(_MARK))).select("*", F.posexplode(F.split(column, _MARK, -1)).alias("_piece", "found")).where("_piece % 2 = 1")
    start = F.length(F.call_function("substring_index", F.col(column), F.lit(_MARK), F.col("_piece"))) - F.col("_piece") + 1
    return pieces.withColumn("start", start).withColumn("turn", ((F.col("_piece") - 1) / 2).cast("int")).drop("_piece")


def spans(text: Column, pattern: str) -> Column:
    """array<struct<found,start,end>> of all matches; the pattern must not match an empty string. The pattern runs once."""
    kind = "array<struct<found:string,start:int,end:int>>"
    odd = is_odd(text)
    marked_text = marked(unmarked(text), pattern)

    def step(done: Column, x: Column) -> Column:
        end = done["at"] + F.length(x)
        one = F.array(F.struct(x.alias("found"), done["at"].alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), (~done["inside"]).alias("inside"), F.when(done["inside"], F.concat(done["out"], one.cast(kind))).otherwise(done["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.lit(False).alias("inside"), F.array().cast(kind).alias("out"))
    out = F.aggregate(F.split(marked_text, _MARK, -1), begin, step, lambda done: done["out"])
    as_it_was = lambda m: F.struct(F.substring(text, m["start"] + 1, m["end"] - m["start"]).alias("found"), m["start"].alias("start"), m["end"].alias("end"))
    return let(out, lambda ms: F.when(odd, F.transform(ms, as_it_was)).otherwise(ms))


def first_at(text: Column, pattern: str) -> Column:
    """Offset of the first match, null without one."""
    return F.when(text.rlike(pattern), F.length(F.get(F.split(text, pattern, 2), F.lit(0))))


def evidence(text: Column, start: Column, end: Column, window: int = 120) -> Column:
    left = F.greatest(start - window // 2, F.lit(0))
    return F.trim(collapsed(F.substring(text, left + 1, F.least(end + window, F.length(text)) - left)))


def looked_up(key: Column, table: dict) -> Column:
    """The value of key in a small literal table, null without one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once, also where use has it inside another lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _first(values: Column) -> Column:
    return F.get(values, F.lit(0))


def _fold(name: str) -> str:
    return " ".join("".join(c if c.isalnum() else " " for c in name.lower().replace("&", "and")).split())


def department(raw: Column) -> Column:
    """The canonical department of a heading: equal when folded, else the first of which one is a prefix of the other."""
    name = F.regexp_replace(F.regexp_replace(stripped(collapsed(raw), r" \-–—,."), r"\(.*?\)", " "), r"(?i)\bDEPARTMENT\b", "")
    known = F.array(*[F.struct(F.lit(d).alias("name"), F.lit(_fold(d)).alias("fold")) for d in V.DEPARTMENTS])

    def canonical(name: Column) -> Column:
        prefix = lambda fold: _first(F.filter(known, lambda d: F.startswith(fold, d["fold"]) | F.startswith(d["fold"], fold)))["name"]
        found = let(folded(name), lambda fold: F.coalesce(looked_up(fold, {_fold(d): d for d in V.DEPARTMENTS}), prefix(fold)))
        other = F.when((F.upper(name) == name) & (F.lower(name) != name), F.initcap(name)).otherwise(name)
        return F.when(name == "", F.lit("")).otherwise(F.coalesce(found, other))

    return let(stripped(collapsed(name), r" \-–—,."), canonical)


def is_department(name: Column) -> Column:
    return folded(name).isin([_fold(d) for d in V.DEPARTMENTS])


def district(raw: Column) -> Column:
    known = {d.lower(): d for d in V.DISTRICTS} | V.DISTRICT_ALIASES
    return looked_up(folded(raw), known)


def bucket(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return reduce(lambda c, kb: c.when(F.contains(low, F.lit(kb[0])), kb[1]), V.BUCKETS, F.when(F.lit(False), "")).otherwise("other")


def built_date(day: Column, month: Column, year: Column) -> Column:
    """A date, null if there is no such day; two-digit years up to 69 are of this century."""
    y = F.when(year < 70, year + 2000).when(year < 100, year + 1900).otherwise(year)
    return F.concat(F.lpad(y.cast("string"), 4, "0"), F.lit("-"), month.cast("string"), F.lit("-"), day.cast("string")).try_cast("date")


def parsed_date(value: Column) -> Column:
    iso = F.when(F.trim(value).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(F.trim(value)))
    rx = r"^(\d{1,2})[./-](\d{1,2})[./-](\d{4})"
    part = lambda i: F.regexp_extract(F.trim(value), rx, i).try_cast("int")
    return F.coalesce(iso, F.when(F.trim(value).rlike(rx), built_date(part(1), part(2), part(3))))


def parsed_money(value: Column) -> Column:
    """Rupees; the unit must follow the digits."""
    rx = r"(?i)(\d+(?:\.\d+)?)\s*(crores?|lakhs?|lacs?|thousand)?\b"
    plain = F.replace(value, F.lit(","), F.lit(""))
    unit = F.lower(F.regexp_extract(plain, rx, 2))
    return F.when(plain.rlike(rx), F.regexp_extract(plain, rx, 1).try_cast("double") * F.coalesce(looked_up(unit, V.UNITS), F.lit(1)))


def overlap(left: Column, right: Column) -> Column:
    """Jaccard similarity of the distinct words of two folded texts."""
    words = lambda x: F.array_distinct(F.filter(F.split(x, " "), lambda w: w != ""))
    a, b = words(left), words(right)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def values_match(field: Column, expected: Column, actual: Column) -> Column:
    """Whether two values of a field mean the same."""
    e, a = F.trim(expected), F.trim(actual)
    fe, fa = compared(e), compared(a)
    series = lambda x: F.lower(F.regexp_extract(x, r"(?i)\b(Ms|Rt|D|P)\b", 1))
    number = (digits(e) == digits(a)) & ((series(e) == "") | (series(a) == "") | (series(e) == series(a)))
    de, da, me, ma = parsed_date(e), parsed_date(a), parsed_money(e), parsed_money(a)
    dates = F.when(de.isNotNull() & da.isNotNull(), de == da).otherwise(fe == fa)
    money = F.when(me.isNotNull() & ma.isNotNull(), F.abs(me - ma) < 1.0).otherwise(fe == fa)
    places = F.coalesce(district(e), fe) == F.coalesce(district(a), fa)
    subject = F.contains(fe, fa) | F.contains(fa, fe) | (overlap(fe, fa) >= 0.9)
    by_field = F.when(field == "go_number", number).when(field == "go_date", dates).when(field == "budget", money).when(field == "district", places).when(field == "subject", subject)
    return F.when((e == "") | (a == ""), e == a).otherwise(by_field.otherwise(fe == fa))


def script_counts(text: Column, first: str, second: str = "A-Za-z") -> tuple[Column, Column]:
    """Characters of two classes, which must not share any. Runs of a class are taken out: looking for runs of other characters is slow where there are none."""
    without = lambda text, chars: F.regexp_replace(text, f"[{chars}]+", "")
    rest = without(text, first)
    return (F.length(text) - F.length(rest)).cast("bigint"), (F.length(rest) - F.length(without(rest, second))).cast("bigint")


def language(first: Column, second: Column, names: tuple[str, str], dominant: float = 0.85) -> Column:
    total = first + second
    return F.when(total == 0, "unknown").when(first / total >= dominant, names[0]).when(second / total >= dominant, names[1]).otherwise("mixed")
