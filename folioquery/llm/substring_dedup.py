"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of each SPAN consecutive SEED-word grams the one of least hash, chosen by content alone, so two
equal runs of WINDOW words always choose the same one. Documents meet on the anchors they share. From its anchor each extends both
ways, over all runs of WINDOW words that chose it, to a segment. Where a document with a smaller doc_id extends to the same segment,
the whole of it repeats; where segments of an anchor differ, they are compared run by run. Touching runs merge to maximal
repeats, of WINDOW words or more. A word goes if it lies in a run that a document with a smaller doc_id also holds.

No pairs are made: anchors, and then runs, are sorted and each is compared with the first of its kind alone. Shuffled are one anchor
in five words or so with the hash of its segment, the texts once, and the runs of segments that differ. Segments of an anchor are told
apart by 64 bits of their own, as the anchor's hash is the same for all of them; runs by 96. M unlike segments of an anchor give about
M * M / 2**65 false matches, under one in a million at M = 5,000,000.

Hot keys are combined before they are shuffled, in each slice of about a megabyte of text: a segment or run that a smaller doc_id of the same slice
holds is decided there, and so is an anchor with HOT unlike segments or more, whose runs are compared singly; what is decided goes to any
task. So one task gets a few rows of a hot key for each slice, not for each document, and they stream in constant memory.

Defined results: a null text has no words; fewer than WINDOW words lose nothing; equal texts lose all their words but for
the smallest doc_id; rows that share a doc_id do not take words from each other; a null doc_id counts as larger
than any other; an empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, mix, shared_folder, slices, table, words_of

WINDOW = 13
SEED = 5
#: Unlike segments of an anchor in one slice from which on they are compared run by run at once.
HOT = 8
_LAST = (1 << 63) - 1
_OUTPUTS = {"kept": "string", "spans": "array<struct<start:int,end:int>>", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"}


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each run of window words: the word it starts at, the word its anchor starts at, and the anchor's hash."""
    grams, at = words.grams(SEED)
    span = window - SEED + 1
    if len(grams) < span:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    first = np.flatnonzero(at[span - 1 :] - at[: len(at) - span + 1] == span - 1)
    best = grams[first]
    place = first.copy()
    for j in range(1, span):
        value = grams[first + j]
        less = value < best
        best = np.where(less, value, best)
        place[less] = first[less] + j
    return at[first], at[place], best


def _owner(words: Words, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(words.first, at, side="right") - 1


#: What names a row: its doc_id and, as doc_ids may repeat, 64 bits of doc_id and text.
NAME = ["turn", "k"]


def _named(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("bigint")
    return docs.select(doc_id.alias("doc_id"), "text", F.xxhash64(doc_id, "text").alias("k"), F.coalesce(doc_id, F.lit(_LAST)).alias("turn"))


def segments(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(anchor, segment, turn, k, at, n): each anchor of each row of docs with its n runs, the first at word at.

    Rows decided in their slice have a random anchor and n negated: those with a segment that a smaller turn has, and, with at inverted (~at),
    those to be compared run by run, for whose anchor a row with n = 0 stands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = words_of(batch.column("text"))
            start, place, value = _anchors(words, window)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])[: len(place)])
            n = np.diff(np.append(first, len(place)))
            at = start[first]
            doc = _owner(words, at)
            segment = _range_hashes(words.hash, at, at + n + window - 1)
            anchor = value[first].view(np.int64)
            turn, k = (np.asarray(batch.column(c))[doc] for c in ("turn", "k"))
            at = at - words.first[doc]
            order = np.lexsort((turn, segment, anchor))
            new_anchor, new_segment = _changes(anchor[order]), _changes(anchor[order], segment[order])
            whole = turn[order] > turn[order][new_segment][np.cumsum(new_segment) - 1]
            group = np.cumsum(new_anchor) - 1
            check = ~whole & (np.bincount(group, new_segment) >= HOT)[group] if len(order) else whole
            stands = order[new_anchor & check]
            whole, check = order[whole], order[check]
            marks = [anchor[stands], segment[stands], np.full(len(stands), _LAST), k[stands], np.zeros(len(stands)), np.zeros(len(stands))]
            n[whole] *= -1
            n[check] *= -1
            at[check] = ~at[check]
            decided = np.concatenate([whole, check])
            anchor[decided] = mix((k[decided] + at[decided]).view(np.uint64)).view(np.int64)  # any task will do
            columns = [np.concatenate(c).astype(t) for *c, t in zip([anchor, segment, turn, k, at, n], marks, [np.int64] * 4 + [np.int32] * 2, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["anchor", "segment", "turn", "k", "at", "n"])

    return docs.select("text", "turn", "k").mapInArrow(run, "anchor bigint, segment bigint, turn bigint, k bigint, at int, n int")


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the one before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _range_hashes(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of words: differences of a running polynomial sum, shifted to the range's start."""
    base = 0xD1342543DE82EF95
    power = np.full(len(hashes) + 1, base, np.uint64)
    back = np.full(len(hashes) + 1, pow(base, -1, 1 << 64), np.uint64)
    power[:1] = back[:1] = 1
    power, back = power.cumprod(dtype=np.uint64), back.cumprod(dtype=np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * power[:-1], dtype=np.uint64)])
    return mix((total[end] - total[start]) * back[start] + (end - start).astype(np.uint64)).view(np.int64)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (anchor, segment, turn): whole for those whose segment a smaller turn has; of the others, those whose anchor
    has several segments, which are to be compared run by run. Rows decided before come as they are."""
    last, least, several, waiting = None, 0, False, []
    for batch in batches:
        at, n = (np.asarray(batch.column(c)) for c in ("at", "n"))
        if (n < 0).any():
            given = [pa.array(c[n < 0]) for c in (*(np.asarray(batch.column(c)) for c in NAME), np.where(at < 0, ~at, at), -n, at >= 0)]
            yield pa.RecordBatch.from_arrays(given, [*NAME, "at", "n", "whole"])
            batch = batch.filter(pa.array(n >= 0))
        if not batch.num_rows:
            continue
        anchor, segment, turn = (np.asarray(batch.column(c)) for c in ("anchor", "segment", "turn"))
        rows = batch.select([*NAME, "at", "n"])
        new_anchor = np.concatenate([[last is None or anchor[0] != last[0]], anchor[1:] != anchor[:-1]])
        new_segment = new_anchor | np.concatenate([[last is None or segment[0] != last[1]], segment[1:] != segment[:-1]])
        group = np.cumsum(new_segment)  # 0 goes on with the batch before
        firsts = np.concatenate([[least], turn[new_segment]])
        whole = turn > firsts[group]
        of_anchor = np.cumsum(new_anchor)
        stands = np.asarray(batch.column("n")) == 0
        many = np.bincount(of_anchor, (new_segment & ~new_anchor) | stands, of_anchor[-1] + 1) > 0
        many[0] |= several
        if many[0] or of_anchor[0]:
            if many[0]:
                yield from (_marked(w, False) for w in waiting)
            waiting = []
        if many[0] and of_anchor[0]:  # nothing of this batch goes on with it
            many[0] = False
        check = ~whole & many[of_anchor] & ~stands
        whole &= ~stands
        if whole.any():
            yield _marked(rows.filter(pa.array(whole)), True)
        if check.any():
            yield _marked(rows.filter(pa.array(check)), False)
        waiting = waiting if of_anchor[-1] == 0 else []
        if not many[-1]:  # another segment may follow in the next batch
            waiting.append(rows.filter(pa.array((of_anchor == of_anchor[-1]) & ~whole)))
        last, least, several = (anchor[-1], segment[-1]), firsts[-1], bool(many[-1])


def _marked(rows: pa.RecordBatch, whole: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(np.full(rows.num_rows, whole))], [*NAME, "at", "n", "whole"])


def runs(docs: DataFrame, places: DataFrame, window: int = WINDOW) -> DataFrame:
    """(r1, r2, turn, k, at): the runs of window words that places(turn, k, checks) lists, checks being array<struct<at,n>>.

    Of runs that a smaller turn of the same slice has, at is inverted and r1 random.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = words_of(batch.column("text"))
            at = _starts(words, batch.column("checks"))
            one, every = words.grams(window, 1)
            two, _ = words.grams(window, 2)
            where = np.searchsorted(every, at)
            doc = _owner(words, at)
            r1, r2 = one[where].view(np.int64), two[where].astype(np.uint32).view(np.int32)
            turn, k = (np.asarray(batch.column(c))[doc] for c in ("turn", "k"))
            at = (at - words.first[doc]).astype(np.int32)
            order = np.lexsort((turn, r2, r1))
            new = _changes(r1[order], r2[order])
            later = order[turn[order] > turn[order][new][np.cumsum(new) - 1]]
            at[later], r1[later] = ~at[later], mix((k[later] + at[later]).view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (r1, r2, turn, k, at)], ["r1", "r2", "turn", "k", "at"])

    return docs.join(places, NAME).select("text", "turn", "k", "checks").mapInArrow(run, "r1 bigint, r2 int, turn bigint, k bigint, at int")


def _starts(words: Words, listed: pa.ListArray) -> np.ndarray:
    """The words at which the listed runs (at, n) of each text start."""
    many = np.diff(np.asarray(listed.offsets))
    flat = listed.flatten()
    at, n = (np.asarray(flat.field(i)).astype(np.int64) for i in (0, 1))
    first = np.repeat(at + words.first[np.repeat(np.arange(len(many)), many)], n)
    return first + np.arange(len(first)) - np.repeat(np.cumsum(n) - n, n)


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (r1, r2, turn) those with a larger turn than the first of their run, and those decided before."""
    last, least = None, 0
    for batch in batches:
        at = np.asarray(batch.column("at"))
        if (at < 0).any():
            yield pa.RecordBatch.from_arrays([*[pa.array(np.asarray(batch.column(c))[at < 0]) for c in NAME], pa.array(~at[at < 0])], [*NAME, "at"])
            batch = batch.filter(pa.array(at >= 0))
        if not batch.num_rows:
            continue
        one, two, turn = (np.asarray(batch.column(c)) for c in ("r1", "r2", "turn"))
        start = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
        first = turn[start]
        if (one[0], two[0]) == last:
            first[0] = least
        yield batch.select([*NAME, "at"]).filter(pa.array(turn > np.repeat(first, np.diff(np.append(start, len(one))))))
        last, least = (one[-1], two[-1]), first[-1]


def repeats(named: DataFrame, window: int = WINDOW) -> DataFrame:
    """(turn, k, starts): the runs (at, n) of each row that a smaller doc_id also holds."""
    spark = named.sparkSession
    met = segments(named, window).repartition("anchor").sortWithinPartitions("anchor", "segment", "turn").mapInArrow(_compared, "turn bigint, k bigint, at int, n int, whole boolean")
    listed = lambda which: F.collect_list(F.when(which, F.struct("at", "n")))
    folder = f"{shared_folder(spark)}/repeats-{uuid.uuid4().hex}"
    met.groupBy(*NAME).agg(listed(F.col("whole")).alias("starts"), listed(~F.col("whole")).alias("checks")).write.parquet(folder)
    known = spark.read.parquet(folder)
    held = runs(named, known.where(F.size("checks") > 0).select(*NAME, "checks"), window).repartition("r1", "r2").sortWithinPartitions("r1", "r2", "turn")
    single = held.mapInArrow(_later, "turn bigint, k bigint, at int").groupBy(*NAME).agg(F.collect_list(F.struct("at", F.lit(1).alias("n"))).alias("more"))
    return known.select(*NAME, "starts").join(single, NAME, "left").select(*NAME, F.concat("starts", F.coalesce("more", F.array().cast("array<struct<at:int,n:int>>"))).alias("starts"))


def without_repeats(docs: DataFrame, window: int = WINDOW, outputs: tuple[str, ...] = ("kept", "spans", "n_words", "n_removed")) -> DataFrame:
    """(doc_id, *outputs) of each row of docs(doc_id, text): kept words joined by a space; spans are the maximal repeats, in words."""
    named = _named(docs)
    none = F.array().cast("array<struct<at:int,n:int>>")
    rows = named.join(repeats(named, window), NAME, "left").select("doc_id", "text", F.coalesce("starts", none).alias("starts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = words_of(batch.column("text"))
            at = _starts(words, batch.column("starts"))
            change = np.bincount(at, minlength=len(words.hash) + 1) - np.bincount(at + window, minlength=len(words.hash) + 1)
            n = np.diff(words.first)
            gone = np.cumsum(change[:-1]) > 0
            removed = np.add.reduceat(np.append(gone, 0), words.first[:-1]) * (n > 0)
            texts = _kept(words, ~gone)
            made = {
                "kept": lambda texts=texts: pa.array(texts, pa.binary()).cast(pa.string()),
                "spans": lambda words=words, gone=gone: pa.array([_spans(gone[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                "n_words": lambda n=n: pa.array(n.astype(np.int64)),
                "n_removed": lambda removed=removed: pa.array(removed.astype(np.int64)),
                "kept_sha256": lambda texts=texts: pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
            }
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(made[o]() for o in outputs)], ["doc_id", *outputs])

    return rows.mapInArrow(run, "doc_id bigint, " + ", ".join(f"{o} {_OUTPUTS[o]}" for o in outputs))


def _kept(words: Words, keep: np.ndarray) -> list[bytes]:
    start, long = words.start[keep], (words.end - words.start)[keep]
    out = np.full(int(long.sum()) + len(long), 32, np.uint8)
    total = int(long.sum())
    inner = np.arange(total) - np.repeat(np.cumsum(long) - long, long)
    out[np.arange(total) + np.repeat(np.arange(len(long)), long)] = words.data[np.repeat(start, long) + inner]
    many = np.concatenate([[0], np.cumsum(keep)])[words.first]
    place = np.concatenate([[0], np.cumsum(long + 1)])[many]
    flat = out.tobytes()
    return [flat[a : b - 1] if b > a else b"" for a, b in zip(place[:-1].tolist(), place[1:].tolist(), strict=True)]


def _spans(gone: np.ndarray) -> list[dict[str, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    return [{"start": a, "end": b} for a, b in edge.reshape(-1, 2).tolist()]


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents"), outputs=("n_words", "n_removed", "kept_sha256"))


QUERIES = {"op5_substring_dedup": op5_substring_dedup}
ORACLE_SQL: dict[str, str] = {}
