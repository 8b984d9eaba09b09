import hashlib
import os
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from folioquery.streaming import streams
from folioquery.streaming.store import Store


class Held:
    def __init__(self, value=None):
        self.value, self.exists = value, value is not None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value, self.exists = value, True


def moved(entries, state, *names):
    frames = [pd.DataFrame(f, columns=["event_id", "status"]) for f in entries]
    return [tuple(x) for f in streams.status_moves((1,), iter(frames), state) for x in f[["event_id", "before", "status", "kind"]].astype(object).where(lambda d: d.notna(), None).to_numpy()]


def test_status_moves_over_several_frames(monkeypatch):
    monkeypatch.setattr(streams, "HELD", 3)
    state = Held()
    assert moved([[(4, "b"), (2, "a")], [(3, "b"), (5, "c")]], state) == [(2, None, "a", "new"), (4, "a", "b", "new"), (3, "a", "b", "new"), (4, "b", "b", "moved"), (5, "b", "c", "new")]
    assert state.value == ([3, 4, 5], ["b", "b", "c"], True)
    assert moved([[(1, "x"), (4, "b"), (9, "c")]], state) == [(1, None, "x", "late"), (9, "c", "c", "new")]
    assert state.value == ([4, 5, 9], ["b", "c", "c"], True)


@pytest.fixture(scope="module")
def shuffled(tmp_path_factory):
    """An events folder of 24 files over 120 days that come newest first, then oldest, then in no order; and its rows."""
    r, top = random.Random(3), tmp_path_factory.mktemp("events")
    start = datetime(2024, 1, 1)
    rows = sorted((start + timedelta(minutes=r.randrange(120 * 1440)), r.randrange(1, 9), r.choice(["view", "click", "error"]), r.randrange(100) / 4) for _ in range(720))
    rows = [(i, ts, user + i // 240 * 8, kind, value) for i, (ts, user, kind, value) in enumerate(rows)]  # users come and go
    rows[41] = (41, rows[40][1] + timedelta(hours=6), 30, "view", 1.0)
    rows[40] = (40, rows[40][1], 30, "view", 1.0)  # six hours apart to the second, so two sessions
    order = [*range(23, 15, -1), *range(8), *r.sample(range(8, 16), 8)]
    os.mkdir(top / "events.parquet")
    for turn, part in enumerate(order):
        event_id, ts, user_id, event_type, value = zip(*rows[part * 30 : part * 30 + 30], strict=True)
        path = top / f"events.parquet/part-{part}.parquet"
        pq.write_table(pa.table({"event_id": event_id, "ts": pa.array(ts, pa.timestamp("us")), "user_id": user_id, "event_type": event_type, "value": value, "props": ["{}"] * 30}), path)
        os.utime(path, (1_700_000_000 + 60 * turn,) * 2)
    return str(top), rows


def collected(df):
    return sorted(tuple(x) for x in df.collect())


def test_daily_counts_of_files_in_no_order(spark, shuffled):
    n, total = Counter(), Counter()
    for _, ts, _, kind, value in shuffled[1]:
        n[f"{ts:%Y-%m-%d}", kind] += 1
        total[f"{ts:%Y-%m-%d}", kind] += value
    assert collected(streams.stream_daily_counts(spark, shuffled[0])) == sorted((*k, n[k], total[k]) for k in n)


def test_rolling_failures_of_files_in_no_order(spark, shuffled):
    n = Counter(f"{ts - timedelta(days=d):%Y-%m-%d}" for _, ts, _, kind, _ in shuffled[1] if kind == "error" for d in range(7))
    assert collected(streams.stream_rolling_failures(spark, shuffled[0])) == sorted(n.items())


def test_first_seen_of_files_in_no_order(spark, shuffled):
    assert collected(streams.stream_first_seen(spark, shuffled[0])) == sorted({(user, kind) for _, _, user, kind, _ in shuffled[1]})


def test_sessions_of_files_in_no_order(spark, shuffled):
    times, want = defaultdict(list), []
    for _, ts, user, _, _ in shuffled[1]:
        times[user].append(ts)
    for user, all_of in times.items():
        last = None
        for ts in sorted(all_of):
            if last is None or ts - last >= timedelta(hours=6):
                want.append([user, f"{ts:%Y-%m-%d %H:%M:%S}", 0])
            want[-1][2] += 1
            last = ts
    assert collected(streams.stream_sessions(spark, shuffled[0])) == sorted(map(tuple, want))


@pytest.mark.parametrize("held", [2, 64])
def test_status_changes_of_files_in_no_order(spark, shuffled, monkeypatch, held):
    """With two entries held, most files are late."""
    monkeypatch.setattr(streams, "HELD", held)
    names, now, want = {"view": "new", "click": "downloaded", "error": "rejected"}, {}, []
    for event_id, _, user, kind, _ in shuffled[1]:
        if now.get(user) != names[kind]:
            want.append((user, event_id, now.get(user), names[kind]))
        now[user] = names[kind]
    out = streams.stream_status_changes(spark, shuffled[0]).collect()
    assert sorted(map(tuple, out), key=lambda x: x[1]) == sorted(want, key=lambda x: x[1])


def test_a_second_run_goes_on_from_the_first(spark, shuffled, tmp_path):
    """Of 24 files, 15 are there at the first run; the second reads the other nine alone and gives what one run over all gives."""
    names = sorted(os.listdir(f"{shuffled[0]}/events.parquet"), key=lambda n: os.path.getmtime(f"{shuffled[0]}/events.parquet/{n}"))
    names, part = [n for n in names if n.endswith(".parquet") and not n.startswith(".")], tmp_path / "part"
    os.makedirs(part / "events.parquet")
    jobs = (streams.stream_daily_counts, streams.stream_first_seen, streams.stream_sessions, streams.stream_status_changes)
    for n in names[:15]:
        os.link(f"{shuffled[0]}/events.parquet/{n}", part / "events.parquet" / n)
    first = {f.__name__: collected(f(spark, str(part), str(tmp_path / f.__name__))) for f in jobs}
    for n in names[15:]:
        os.link(f"{shuffled[0]}/events.parquet/{n}", part / "events.parquet" / n)
    for f in jobs:
        again = collected(f(spark, str(part), str(tmp_path / f.__name__)))
        assert again == collected(f(spark, shuffled[0])) != first[f.__name__]
        assert collected(f(spark, str(part), str(tmp_path / f.__name__))) == again  # nothing new, nothing twice


def made(folder):
    """Number and bucket of each file that the batches of a store wrote."""
    return {(os.path.relpath(d, folder), n): os.stat(f"{d}/{n}").st_mtime_ns for d, _, names in os.walk(f"{folder}/rows") for n in names if n.endswith(".parquet")}


def test_store_replay_and_untouched_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), "k string, n long", F.substring("k", 1, 1))
    fold = streams.summed(["k"], n=F.sum)
    batch = lambda *rows: spark.createDataFrame(rows, "k string, n long")
    assert store.rows().count() == 0 and store.merge(batch(("a", 1)).limit(0), 0, fold) == []
    assert store.merge(batch(("a1", 1), ("a2", 5), ("b1", 1), ("a1", 1)), 0, fold) == ["a", "b"]
    before = made(tmp_path / "t")
    for _ in range(2):  # the second is a replay
        assert store.merge(batch(("b1", 10), ("c", 7)), 1, fold) == ["b", "c"]
        assert collected(store.rows()) == [("a1", 2), ("a2", 5), ("b1", 11), ("c", 7)]
    after = made(tmp_path / "t")
    assert {k: t for k, t in after.items() if "_batch=0" in k[0]} == before and not any("_batch=1" in k[0] and "_bucket=a" in k[0] for k in after)
    assert store.versions() == {"a": 0, "b": 1, "c": 1} and collected(store.rows(only=lambda b: b == "a")) == [("a1", 2), ("a2", 5)]


def test_sessions_move_between_months(spark, tmp_path, monkeypatch):
    """A late entry joins two sessions over a month's end; the month that has no session left is emptied."""
    at = lambda text: datetime.fromisoformat(text)
    files = [["2024-01-31 20:00", "2024-02-01 06:00"], ["2024-02-01 01:00"], ["2024-03-05 00:00", "2023-12-31 23:00"]]
    os.mkdir(tmp_path / "events.parquet")
    for i, times in enumerate(files):
        path = tmp_path / f"events.parquet/part-{i}.parquet"
        n = len(times)
        pq.write_table(pa.table({"event_id": range(n), "ts": pa.array(map(at, times), pa.timestamp("us")), "user_id": [1] * n, "event_type": ["view"] * n, "value": [1.0] * n, "props": ["{}"] * n}), path)
        out = collected(streams.stream_sessions(spark, str(tmp_path), str(tmp_path / "run")))
    assert out == [(1, "2023-12-31 23:00:00", 1), (1, "2024-01-31 20:00:00", 3), (1, "2024-03-05 00:00:00", 1)]
    store = Store(spark, str(tmp_path / "run"), "n long", F.lit(""))
    assert sorted(store.versions()) == ["2023-12", "2024-02", "2024-03"]


def test_state_is_bounded(spark, shuffled, monkeypatch):
    """Folded streams hold no state; the status machine holds a row for each key, of at most HELD entries."""
    seen, start = [], streams.ran

    def ran(stream, folder, write, mode="append"):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()
        seen.append([s.numRowsTotal for p in query.recentProgress for s in p.stateOperators])

    monkeypatch.setattr(streams, "ran", ran)
    for f in (streams.stream_daily_counts, streams.stream_rolling_failures, streams.stream_sessions, streams.stream_first_seen, streams.stream_upsert_seen):
        f(spark, shuffled[0])
    assert not any(seen) and start is not ran
    streams.stream_status_changes(spark, shuffled[0])
    assert max(seen[-1]) == len({user for _, _, user, _, _ in shuffled[1]})


def test_ingest_of_pushes_in_no_order(spark, tmp_path):
    """Pushes of one content, the first without OCR; files come in any order, and a run over the same files changes nothing."""
    rows = [(1, "short", "en", "s"), (2, "short", "en", "s"), (3, "short", "fr", "s"), (4, "short", "fr", "s"), (5, "short", "fr", "t"), (6, "x" * 90, "en", "s"), (7, None, "en", "s"), (8, "labelled", "en", "s"), (9, "labelled", "fr", "s")]
    pq.write_table(pa.table({"doc_id": [8], "quality": [1], "toxic": [0]}), tmp_path / "labels.parquet")
    want = {("s", "short"): (1, 3, 4, 2, False), ("t", "short"): (5, None, 1, 0, False), ("s", "x" * 90): (6, None, 1, 0, False), ("s", "labelled"): (8, None, 2, 1, True)}
    os.mkdir(tmp_path / "documents.parquet")
    for i, part in enumerate(([4, 7, 8], [1, 5, 0], [2, 3, 6])):
        doc_id, text, lang, source = zip(*[rows[j] for j in part], strict=True)
        pq.write_table(pa.table({"doc_id": doc_id, "text": pa.array(text, pa.string()), "lang": lang, "source": source, "n_chars": [0] * 3}), tmp_path / f"documents.parquet/part-{i}.parquet")
        for _ in range(2):
            out = streams.stream_ingest(spark, str(tmp_path), str(tmp_path / "run")).collect()
    names = {hashlib.sha256(t.encode()).hexdigest(): t for _, t, _, _ in rows if t}
    assert {(x["source"], names[x["sha256"]]): (x["record_id"], x["reparsed_by"], x["n_pushes"], x["n_skipped"], x["needs_ocr"]) for x in out} == want
    numbers = {k[0].split("/")[1] for k in made(tmp_path / "run")}
    assert numbers == {"_batch=0", "_batch=1", "_batch=2"}
