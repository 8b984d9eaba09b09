"""A queue of requests that several agents claim without locks: every action names the version that its agent last saw, and loses where that is gone."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import Catalog
from ..sources.tables import load
from .records import zero_filled

C = Catalog()
QUEUED, CLAIMED, RUNNING, COMPLETED = STATUSES = ("QUEUED", "CLAIMED", "RUNNING", "COMPLETED")
#: action: (statuses it is open to, status after it, whether only the holder may)
ACTIONS = {
    "claim": ((QUEUED,), CLAIMED, False),
    "progress": ((CLAIMED, RUNNING), RUNNING, True),
    "complete": ((CLAIMED, RUNNING), COMPLETED, True),
    "release": ((CLAIMED, RUNNING), QUEUED, True),
    "requeue": ((COMPLETED,), QUEUED, False),
}
_OUT = "request long, turn long, action_id long, action string, agent long, outcome string, status string, version long, holder long"


def outcomes(actions: DataFrame) -> DataFrame:
    """What becomes of each of actions(request, turn, action_id, action, agent, seen), turns of a request counting from 1.

    A compare-and-set: the action succeeds if nothing has changed since turn `seen`, the request's status allows it, and its agent holds the request where it must. Else it
    changes nothing and says why: "stale", "status" or "holder". Rows of a request come to one task in order, which carries only the request's
    present state, so a request may have any number of actions.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        request, status, version, holder, changed = None, QUEUED, 0, None, 0
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                if row.request != request:
                    request, status, version, holder, changed = row.request, QUEUED, 0, None, 0
                open_to, after, held = ACTIONS[row.action]
                outcome = "stale" if changed > row.seen else "status" if status not in open_to else "holder" if held and holder != row.agent else "ok"
                if outcome == "ok":
                    status, version, changed = after, version + 1, row.turn
                    holder = row.agent if row.action == "claim" else None if after == QUEUED else holder
                out.append((request, row.turn, row.action_id, row.action, row.agent, outcome, status, version, holder))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _OUT.split(", ")]).astype({"holder": "Int64"})

    return actions.repartition("request").sortWithinPartitions("request", "turn").mapInPandas(fold, _OUT)


_NAMED = {"click": "claim", "view": "progress", "purchase": "complete", "error": "release", "signup": "requeue"}


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as actions: users are requests, the whole part of a value says the agent, and an agent acts on what it saw up to two turns before."""
    turn = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    rows = load(spark, sf_dir, "events").select(
        F.col("user_id").alias("request"), turn.alias("turn"), F.col("event_id").alias("action_id"),
        F.create_map(*[F.lit(x) for pair in _NAMED.items() for x in pair])[F.col("event_type")].alias("action"),
        F.pmod(F.floor("value"), F.lit(3)).alias("agent"), (F.get_json_object("props", "$.k").cast("long") % 3).alias("late"),
    )
    return rows.withColumn("seen", F.col("turn") - 1 - F.col("late")).drop("late")


def _case(expr: str, pick) -> str:
    return f"CASE {expr} {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {pick(v)}' for k, v in ACTIONS.items())} END"


_SQL = f"""RECURSIVE a AS (SELECT user_id AS request, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS turn, event_id AS action_id,
CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _NAMED.items())} END AS action, CAST(floor(value) AS BIGINT) % 3 AS agent, CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS late FROM events),
walk AS (SELECT DISTINCT request, 0::BIGINT AS turn, NULL::BIGINT AS action_id, NULL::VARCHAR AS action, NULL::BIGINT AS agent, NULL::VARCHAR AS outcome, 'QUEUED' AS status, 0::BIGINT AS version, NULL::BIGINT AS holder, 0::BIGINT AS changed FROM a
UNION ALL SELECT request, turn, action_id, action, agent, outcome, CASE WHEN outcome = 'ok' THEN after ELSE status END, CASE WHEN outcome = 'ok' THEN version + 1 ELSE version END,
CASE WHEN outcome <> 'ok' THEN holder WHEN action = 'claim' THEN agent WHEN after = 'QUEUED' THEN NULL ELSE holder END, CASE WHEN outcome = 'ok' THEN turn ELSE changed END
FROM (SELECT *, CASE WHEN changed > turn - 1 - late THEN 'stale' WHEN NOT list_contains(open_to, status) THEN 'status' WHEN held AND holder IS DISTINCT FROM agent THEN 'holder' ELSE 'ok' END AS outcome
FROM (SELECT a.*, w.status, w.version, w.holder, w.changed, {_case("a.action", lambda v: "['" + "','".join(v[0]) + "']")} AS open_to, {_case("a.action", lambda v: f"'{v[1]}'")} AS after, {_case("a.action", lambda v: str(v[2]).lower())} AS held
FROM walk w JOIN a ON a.request = w.request AND a.turn = w.turn + 1)))"""


@C.query(f"WITH {_SQL} SELECT action_id, request, turn, action, agent, outcome, status, version, holder FROM walk WHERE turn > 0")
def claim_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every action with what became of it and the request's state after it."""
    return outcomes(_actions(spark, sf_dir))


@C.query(
    f"WITH {_SQL} SELECT request, arg_max(status, turn) AS status, max(version) AS version, max(turn) AS n_actions, count(*) FILTER (outcome = 'stale') AS n_stale, count(*) FILTER (outcome IN ('status', 'holder')) AS n_refused FROM walk WHERE turn > 0 GROUP BY request ORDER BY request DESC LIMIT 50"
)
def request_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 requests with their state and conflicts."""
    rows = outcomes(_actions(spark, sf_dir)).groupBy("request")
    state = rows.agg(F.max_by("status", "turn").alias("status"), F.max("version").alias("version"), F.max("turn").alias("n_actions"), F.count_if(F.col("outcome") == "stale").alias("n_stale"), F.count_if(F.col("outcome").isin("status", "holder")).alias("n_refused"))
    return state.orderBy(F.desc("request")).limit(50)


@C.query(
    f"WITH {_SQL}, s AS (SELECT request, arg_max(status, turn) AS status FROM walk GROUP BY request), d AS (SELECT unnest({list(STATUSES)}) AS status) SELECT d.status, count(s.request) AS n FROM d LEFT JOIN s USING (status) GROUP BY d.status"
)
def request_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests in each status, those that no request has too."""
    state = outcomes(_actions(spark, sf_dir)).groupBy("request").agg(F.max_by("status", "turn").alias("status"))
    return zero_filled(state.groupBy("status").agg(F.count(F.lit(1)).alias("n")), "status", STATUSES)


QUERIES, ORACLE_SQL = C.queries, C.oracle_sql
