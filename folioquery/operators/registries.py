"""Registries whose entries have versions in time, the golden set, and counters that are kept and merged."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import Catalog
from ..sources.tables import load
from ..streaming.store import Store, hashed
from ..streaming.streams import BUCKETS, shared_folder, summed
from .quality import _COUNTS, _GRID, _RATES, counters, grid, rates

C = Catalog()

# guarded edits


#: Moments that one task of an as-of join reads for a key.
SPAN = 10_000


def as_of(rows: DataFrame, versions: DataFrame, key: str, at: str, value: str, span: int = SPAN) -> DataFrame:
    """rows with `value` of the version of their key that held just before `at`, a whole number; null where there was none yet.

    Both sides are merged and read in order of time, each key by spans of time, so a key that very many rows have is many tasks; what held when a span began comes
    from a row for each key and span. No row meets every version of its key.
    """
    have = F.lit(None).cast(versions.schema[value].dataType)
    asked = rows.withColumns({"_kind": F.lit(0), "_value": have})  # at the same moment the question comes first
    both = asked.unionByName(versions.select(F.col(key), F.col(at), F.lit(1).alias("_kind"), F.col(value).alias("_value")), allowMissingColumns=True).withColumn("_span", F.floor(F.col(at) / span))
    ends = versions.groupBy(key, F.floor(F.col(at) / span).alias("_span")).agg(F.max_by(value, at).alias("_last"))
    spans = ends.unionByName(rows.select(key, F.floor(F.col(at) / span).alias("_span")).distinct(), allowMissingColumns=True).groupBy(key, "_span").agg(F.first("_last", ignorenulls=True).alias("_last"))
    carried = F.last("_last", ignorenulls=True).over(Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.select(key, "_span", carried.alias("_begun"))
    before = Window.partitionBy(key, "_span").orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, -1)
    held = both.withColumn("_held", F.last("_value", ignorenulls=True).over(before)).where("_kind = 0").join(begun, [key, "_span"], "left")
    return held.select(*rows.columns, F.coalesce("_held", "_begun").alias(value))


#: What an edit needs: an entry that exists, one that is active, and a department that is active at that moment.
GUARDS = {"create": (False, False, True), "move": (True, True, True), "retire": (True, True, False), "restore": (True, False, True), "rename": (True, False, False)}
_DONE = "entry long, edit_id long, action string, outcome string, version long, active boolean, department long"


def guarded_edits(edits: DataFrame) -> DataFrame:
    """What becomes of each of edits(entry, edit_id, action, department, open), taken by edit_id; open says that the department was active then.

    An edit that its guards allow makes the entry's next version; another changes nothing and names the first guard that it fails. Rows of an entry reach one
    task in order, which carries only the entry's present state.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        entry, version, active, department = None, 0, False, None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.entry != entry:
                    entry, version, active, department = row.entry, 0, False, None
                exists, is_active, is_open = GUARDS[row.action]
                outcome = "ok"
                if (version > 0) != exists:
                    outcome = "missing" if exists else "exists"
                elif is_active and not active:
                    outcome = "retired"
                elif row.action == "restore" and active:
                    outcome = "active"
                elif is_open and not row.open:
                    outcome = "closed department"
                if outcome == "ok":
                    version += 1
                    active = {"create": True, "restore": True, "retire": False}.get(row.action, active)
                    department = row.department if is_open else department
                out.append((entry, row.edit_id, row.action, outcome, version, active, department))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _DONE.split(", ")]).astype({"department": "Int64"})

    return edits.repartition("entry").sortWithinPartitions("entry", "edit_id").mapInPandas(fold, _DONE)


_ACTIONS = {"1-URGENT": "create", "2-HIGH": "move", "3-MEDIUM": "retire", "4-NOT SPECIFIED": "rename", "5-LOW": "restore"}


def _departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(department, edit_id, open): versions of departments; each is closed by a line that ships with flag R and opened again by one with flag A."""
    lines = load(spark, sf_dir, "lineitem").where("l_returnflag IN ('A', 'R')").join(load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("department")), "l_suppkey")
    return lines.groupBy("department", F.col("l_orderkey").alias("edit_id")).agg(F.max(F.col("l_returnflag") == "A").alias("open"))


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as edits of agents' keys: a customer is the entry, the priority the action, the total the department."""
    kind = F.create_map(*[F.lit(x) for pair in _ACTIONS.items() for x in pair])[F.trim("o_orderpriority")]
    rows = load(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("entry"), F.col("o_orderkey").cast("long").alias("edit_id"), kind.alias("action"), F.floor(F.col("o_totalprice") % 25).cast("long").alias("department"))
    return as_of(rows, _departments(spark, sf_dir), "department", "edit_id", "open").withColumn("open", F.coalesce("open", F.lit(True)))


def _picked(pick) -> str:
    return " ".join(f"WHEN '{k}' THEN {str(pick(v)).lower()}" for k, v in GUARDS.items())


_FOLD = f"""RECURSIVE d AS (SELECT s_nationkey AS department, l_orderkey AS at, max(l_returnflag = 'A') AS open FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag IN ('A', 'R') GROUP BY 1, 2),
e0 AS (SELECT o_custkey AS entry, o_orderkey AS edit_id, CASE trim(o_orderpriority) {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ACTIONS.items())} END AS action, CAST(floor(o_totalprice % 25) AS BIGINT) AS department FROM orders),
e AS (SELECT e0.*, coalesce(d.open, true) AS open, row_number() OVER (PARTITION BY entry ORDER BY edit_id) AS turn FROM e0 ASOF LEFT JOIN d ON e0.department = d.department AND e0.edit_id > d.at),
g AS (SELECT *, CASE action {_picked(lambda v: v[0])} END AS x, CASE action {_picked(lambda v: v[1])} END AS a, CASE action {_picked(lambda v: v[2])} END AS o FROM e),
walk AS (SELECT DISTINCT entry, 0::BIGINT AS turn, NULL::BIGINT AS edit_id, NULL::VARCHAR AS action, NULL::VARCHAR AS outcome, 0::BIGINT AS version, false AS active, NULL::BIGINT AS department FROM g
UNION ALL SELECT entry, turn, edit_id, action, outcome, CASE WHEN outcome = 'ok' THEN version + 1 ELSE version END, CASE WHEN outcome <> 'ok' THEN active WHEN action = 'retire' THEN false WHEN action IN ('create', 'restore') THEN true ELSE active END, CASE WHEN outcome = 'ok' AND o THEN wanted ELSE department END
FROM (SELECT g.entry, g.turn, g.edit_id, g.action, g.o, g.department AS wanted, w.version, w.active, w.department,
CASE WHEN (w.version > 0) <> g.x THEN CASE WHEN g.x THEN 'missing' ELSE 'exists' END WHEN g.a AND NOT w.active THEN 'retired' WHEN g.action = 'restore' AND w.active THEN 'active' WHEN g.o AND NOT g.open THEN 'closed department' ELSE 'ok' END AS outcome
FROM walk w JOIN g ON g.entry = w.entry AND g.turn = w.turn + 1))"""


@C.query(f"WITH {_FOLD} SELECT edit_id, entry, action, outcome, version, active, department FROM walk WHERE turn > 0")
def guarded_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edit of the agents' keys, with the guard that stopped it or the state that it made; departments count as they were at that moment."""
    return guarded_edits(_edits(spark, sf_dir))


@C.query(
    f"WITH {_FOLD} SELECT entry, version, edit_id AS valid_from, lead(edit_id) OVER (PARTITION BY entry ORDER BY version) AS valid_to, active, department FROM walk WHERE outcome = 'ok'"
)
def registry_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The versions of each entry with the time in which each holds."""
    done = guarded_edits(_edits(spark, sf_dir)).where("outcome = 'ok'")
    after = F.lead("edit_id").over(Window.partitionBy("entry").orderBy("version"))
    return done.select("entry", "version", F.col("edit_id").alias("valid_from"), after.alias("valid_to"), "active", "department")


# the golden set

_STEPS = ("added", "annotated", "completed", "again", "refused")
_GOLD = """x AS (SELECT user_id AS entry, event_id, ts, event_type AS t, min(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id) AS add_id FROM events WHERE event_type <> 'error'),
y AS (SELECT *, min(CASE WHEN t = 'click' AND event_id > add_id THEN event_id END) OVER (PARTITION BY entry) AS a_id, min(CASE WHEN t = 'view' AND event_id > add_id THEN event_id END) OVER (PARTITION BY entry) AS b_id FROM x),
z AS (SELECT *, min(CASE WHEN t = 'purchase' AND event_id > a_id AND event_id > b_id THEN event_id END) OVER (PARTITION BY entry) AS done_id FROM y),
steps AS (SELECT entry, event_id, strftime(ts, '%Y-%m-%d') AS day, CASE WHEN t = 'signup' THEN CASE WHEN event_id = add_id THEN 'added' ELSE 'again' END WHEN t IN ('click', 'view') THEN CASE WHEN event_id > add_id THEN 'annotated' ELSE 'refused' END
WHEN event_id = done_id THEN 'completed' WHEN event_id > done_id THEN 'again' ELSE 'refused' END AS step FROM z)"""


def golden_steps_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(entry, event_id, day, step): what each action on the golden set does. An entry is added once, annotated only then, and complete when both of its fields are."""
    rows = load(spark, sf_dir, "events").where("event_type <> 'error'").select(F.col("user_id").alias("entry"), "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("t"))
    first = lambda df, **kinds: df.groupBy("entry").agg(*[F.min(F.when(c, F.col("event_id"))).alias(name) for name, c in kinds.items()])
    t, at = F.col("t"), F.col("event_id")
    rows = rows.join(first(rows, add_id=t == "signup"), "entry")
    rows = rows.join(first(rows, a_id=(t == "click") & (at > F.col("add_id")), b_id=(t == "view") & (at > F.col("add_id"))), "entry")
    rows = rows.join(first(rows, done_id=(t == "purchase") & (at > F.col("a_id")) & (at > F.col("b_id"))), "entry")
    step = (
        F.when((t == "signup") & (at == F.col("add_id")), "added").when(t == "signup", "again").when(t.isin("click", "view") & (at > F.col("add_id")), "annotated")
        .when((t == "purchase") & (at == F.col("done_id")), "completed").when((t == "purchase") & (at > F.col("done_id")), "again").otherwise("refused")
    )
    return rows.select("entry", "event_id", "day", step.alias("step"))


@C.query(f"WITH {_GOLD} SELECT entry, event_id, step FROM steps")
def golden_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return golden_steps_of(spark, sf_dir).drop("day")


@C.query(
    f"""WITH {_GOLD}, d AS (SELECT day, {", ".join(f"count(*) FILTER (step = '{s}') AS {s}" for s in _STEPS)} FROM steps GROUP BY day)
SELECT day, {", ".join(_STEPS)}, CAST(sum(added) OVER w AS BIGINT) AS n_entries, CAST(sum(completed) OVER w AS BIGINT) AS n_complete FROM d WINDOW w AS (ORDER BY day)"""
)
def golden_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The golden set after each day: what was done, and how many entries there are and are complete; running sums over a row for each day."""
    days = golden_steps_of(spark, sf_dir).groupBy("day").agg(*[F.count_if(F.col("step") == s).alias(s) for s in _STEPS])
    until = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return days.select("day", *_STEPS, F.sum("added").over(until).alias("n_entries"), F.sum("completed").over(until).alias("n_complete"))


# counters kept by run


def merged_counts(store: Store, scored: DataFrame, number: int) -> None:
    """Add the counters of newly scored rows (source, field, outcome) to those kept; rows scored before are not read again."""
    part = scored.groupBy("source", "field").agg(*[c.cast("long") for c in counters()])
    named = part.select("source", "field", *[F.col(c) for c in ("tp", "fp", "fn", "tn")])
    store.merge(named, number, summed(["source", "field"], tp=F.sum, fp=F.sum, fn=F.sum, tn=F.sum))


@C.query(f"WITH {_GRID}, c AS (SELECT source, field, {_COUNTS} FROM outcomes GROUP BY source, field) SELECT source, field, {_RATES} FROM c")
def kept_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by source from counters kept over two runs: what was scored first is not scored or read by the second."""
    store = Store(spark, shared_folder(spark), "source string, field string, tp long, fp long, fn long, tn long", hashed(BUCKETS, "source"))
    scored = grid(spark, sf_dir).select("source", "field", "outcome", F.col("confidence"))
    for number, run in enumerate((F.col("confidence") < 0.5, F.col("confidence") >= 0.5)):
        merged_counts(store, scored.where(run), number)
    return rates(store.rows()).select("source", "field", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "accuracy")


QUERIES, ORACLE_SQL = C.queries, C.oracle_sql
