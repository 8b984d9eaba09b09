"""Spelling variant grouping by forward and backward minimal acyclic automata.

Words are counted over the whole corpus from Arrow buffers. Two words one edit apart agree exactly on the first half of either or on its second half.
The forward automaton reads a word's first half exactly and completes the rest with one error; the backward automaton, over reversed words, reads the second
half exactly and completes the first half. Automata are minimal, and each edge knows how many words come before it, so a path spells the word's number, a
perfect hash into the counts. What both directions find is given once: the backward one passes over words that share the first half.

Words are dealt to automata by their first (last) letters, as many as the shortest half has, or more where the vocabulary is large; a word stands in at most two
groups of a direction. A group too large for a task is dealt into parts, of which each two meet (see group_plan). Each word's best near word and its
number of near words leave a task, never the pairs.

Scale: texts are read once and never shuffled; counts of words are folded in the tasks. The vocabulary is moved a few times as (word, n). Roots are found by doubling
jumps: a form has at least RATIO times the count of its word, so a chain has at most log(count) words and a few rounds do. A form is named by no more
words than lie one edit away from it, which bounds every key of those joins.

Defined results: a null or empty text has no words; a null doc_id counts as an empty string in the keyed deletion; repeated rows count again; words
may have any length; ties go to the word that is first in code-point order; an empty table, or one without repeated words, gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_automaton import advanced
from .common import buffers, by_key, checkpointed, group_plan, slices, table

MIN_LETTERS = 6
MIN_COUNT = 5
RATIO = 5
#: One run in so many, by the hash of document and run, is read without one of its letters.
SLIP = 199
#: Words of one automaton, roughly.
PART = 50_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_NEAR = "word string, n_near long, form_n long, form string"


def words_counted(docs: DataFrame, slip: int = SLIP, min_letters: int = MIN_LETTERS) -> DataFrame:
    """(word, n): runs of Latin letters of docs(doc_id, text) that have min_letters, one in slip read without a letter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, at = buffers(batch.column("text"))
            data = _LOWER[data]
            lead = data == 0xC3  # the letters from U+00C0 to U+00FF are this byte and one more
            inside = lead | ((data >= 97) & (data <= 122))
            inside[1:] |= lead[:-1]
            edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
            opens, closes = edge[:-1] == 1, edge[1:] == -1
            border = at[(at > 0) & (at < len(data))]
            opens[border] |= inside[border]
            closes[border - 1] |= inside[border - 1]
            start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
            second = np.concatenate([[0], np.cumsum(lead)])
            letters = end - start - (second[end] - second[start])
            text = np.searchsorted(at, start, side="right") - 1
            some = letters >= min_letters
            start, end, letters, text = start[some], end[some], letters[some], text[some]
            salt = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in batch.column("doc_id").to_pylist()], np.uint32)
            crc = advanced(salt[text], data, start, end - start)
            slips = crc % np.uint32(slip) == 0
            flat = data.tobytes()
            changed = []
            for i in np.flatnonzero(slips).tolist():
                word, gone = flat[start[i] : end[i]].decode(), int(crc[i]) % int(letters[i])
                changed.append(word[:gone] + word[gone + 1 :])
            start, end = start[~slips], end[~slips]
            kept = np.zeros(len(data) + 1, np.int8)
            kept[start] += 1
            kept[end] -= 1  # where two runs touch, at a border of texts, the two cancel
            own = data[np.cumsum(kept[:-1]) > 0]
            offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
            plain = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(own))
            found = pc.value_counts(pa.chunked_array([plain, pa.array([w for w in changed if len(w) >= min_letters], pa.large_string())]))
            yield pa.RecordBatch.from_arrays([found.field(0).cast(pa.string()), found.field(1)], ["word", "n"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Automaton:
    """The minimal acyclic automaton of sorted distinct words; a word's number is its place among them."""

    def __init__(self, words: list[str]):
        self.edges: list[dict] = [{}]  # letter -> (state, words that come before it from here)
        self.final, self.count = [False], [0]
        known: dict = {}
        free: list[int] = []
        path, last = [0], ""
        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            self._close(path, last, same, known, free)
            for letter in word[same:]:
                if free:
                    state = free.pop()
                else:
                    state = len(self.edges)
                    self.edges.append({})
                    self.final.append(False)
                    self.count.append(0)
                self.edges[path[-1]][letter] = state
                path.append(state)
            self.final[path[-1]] = True
            last = word
        self._close(path, last, 0, known, free)
        self._number(0)

    def _close(self, path: list[int], last: str, down_to: int, known: dict, free: list[int]) -> None:
        """Merge the states of the last word beyond down_to letters with equal ones."""
        for i in range(len(last), down_to, -1):
            state = path.pop()
            self._number(state)
            same = known.setdefault((self.final[state], tuple((c, t) for c, (t, _) in self.edges[state].items())), state)
            if same != state:
                self.edges[state], self.final[state] = {}, False
                free.append(state)
            self.edges[path[-1]][last[i - 1]] = same

    def _number(self, state: int) -> None:
        n = int(self.final[state])
        edges = self.edges[state]
        for letter, target in edges.items():
            edges[letter] = (target, n)
            n += self.count[target]
        self.count[state] = n

    def follow(self, letters: str, state: int = 0, number: int = 0, at: int = 0) -> tuple[int, int] | None:
        """State and number after letters[at:], if there is a path."""
        edges = self.edges
        for i in range(at, len(letters)):
            step = edges[state].get(letters[i])
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def one_error(self, half: str, rest: str) -> list[int]:
        """Numbers of the words that are half, then rest with exactly one letter inserted, deleted or replaced; each once."""
        begun = self.follow(half)
        found: list[int] = []
        if begun is None:
            return found
        state, number = begun

        def complete(state: int, number: int, at: int) -> None:
            ended = self.follow(rest, state, number, at)
            if ended and self.final[ended[0]]:
                found.append(ended[1])

        for i in range(len(rest) + 1):
            own = rest[i] if i < len(rest) else None
            before = rest[i - 1] if i else None
            if own is not None and own != before:  # of equal letters side by side, deleting the first stands for all
                complete(state, number, i + 1)
            for letter, (target, skipped) in self.edges[state].items():
                if letter != before:  # inserting a letter after its like is the same as before it
                    complete(target, number + skipped, i)
                if own is not None and letter != own:
                    complete(target, number + skipped, i + 1)
            step = self.edges[state].get(own)
            if step is None:
                break
            state, number = step[0], number + step[1]
        return found


def _near(group: pa.Table) -> pa.RecordBatch | None:
    """For each asking word of a group the number and the best of its near words in it; with two parts, those in the other part."""
    backward = group.column("way")[0].as_py() == 1
    parts = {}
    for own in {group.column("_i")[0].as_py(), group.column("_j")[0].as_py()}:
        parts[own] = group.filter(pc.equal(group.column("_own"), own))
    out = []
    for own, asking in parts.items():
        other = parts[own] if len(parts) == 1 else next(t for o, t in parts.items() if o != own)
        other = other.filter(other.column("listed"))
        asking = asking.filter(asking.column("asks"))
        spelled, counts = other.column("spelled").to_pylist(), other.column("n").to_pylist()
        if not spelled or not asking.num_rows:
            continue
        automaton = Automaton(spelled)
        for word in asking.column("spelled").to_pylist():
            first = len(word) // 2
            size = len(word) - first if backward else first
            near = automaton.one_error(word[:size], word[size:])
            if backward and near:
                near = [x for x in near if spelled[x][-first:] != word[-first:]]  # the others are found forwards
            if near:
                best = max(counts[x] for x in near)
                forms = [spelled[x][::-1] if backward else spelled[x] for x in near if counts[x] == best]
                out.append((word[::-1] if backward else word, len(near), best, min(forms)))
    if not out:
        return None
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["word", "n_near", "form_n", "form"])


def near_words(vocabulary: DataFrame, min_letters: int = MIN_LETTERS, reach: int | None = None, part: int = PART) -> DataFrame:
    """(word, n_near, form_n, form) of each word of vocabulary(word, n) with near ones: the best has the largest n, then the first in order.

    reach is the number of letters by which words are dealt to automata, at most; it grows with the vocabulary.
    """
    if reach is None:
        reach, many = min_letters // 2, vocabulary.count()
        while many > 1_000_000 << 2 * (reach - min_letters // 2):
            reach += 1
    long = F.length("word")
    rows = []
    for way, half in ((0, lambda n: F.floor(n / 2)), (1, lambda n: F.ceil(n / 2))):
        spelled = F.reverse("word") if way else F.col("word")

        def size(n: Column, half: Callable[[Column], Column] = half) -> Column:
            return F.least(half(n), F.lit(reach)).cast("int")

        # a word asks under its own half and is listed under the halves of words of its length and of one letter less or more
        sizes = F.array_distinct(F.transform(F.array(F.greatest(long - 1, F.lit(min_letters)), long, long + 1), lambda n: size(n)))
        posted = vocabulary.select(F.lit(way).alias("way"), spelled.alias("spelled"), "n", size(long).alias("own"), F.explode(sizes).alias("size"))
        rows.append(posted.select("way", F.col("spelled").substr(F.lit(1), F.col("size")).alias("key"), "spelled", "n", (F.col("own") == F.col("size")).alias("asks"), F.lit(True).alias("listed")))
    grouped = group_plan(rows[0].unionByName(rows[1]), ["way", "key"], F.col("spelled"), part)
    found = by_key(grouped, ["way", "key", "_i", "_j"], _near, _NEAR, ("spelled",))
    best = F.min(F.struct((-F.col("form_n")).alias("n"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.n")).alias("form_n"), "best.form")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each word of forms(word, form): the last word that forms lead to. Counts rise along a chain, so there is no way back."""
    now = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        jumps = now.select(F.col("word").alias("root"), F.col("root").alias("far"))
        met = checkpointed(now.join(jumps, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("went")))
        now = met.select("word", "root")
        if met.where("went").isEmpty():
            return now


def grouped(docs: DataFrame, min_letters: int = MIN_LETTERS, min_count: int = MIN_COUNT, ratio: int = RATIO, slip: int = SLIP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of docs(doc_id, text) with min_letters and min_count."""
    vocabulary = checkpointed(words_counted(docs, slip, min_letters).where(F.col("n") >= min_count))
    near = vocabulary.join(near_words(vocabulary, min_letters), "word", "left")
    fits = F.col("form_n") >= ratio * F.col("n")
    words = checkpointed(near.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("form_n")).alias("form_n"), F.when(fits, F.col("form")).alias("form")))
    ends = roots(words.where("form IS NOT NULL"))
    return words.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants}
ORACLE_SQL: dict[str, str] = {}
