"""Token ids in wavelet-matrix shards.

Documents are put in ascending doc_id order by a range partitioning; each task encodes its range and cuts it into shards of about
SHARD_IDS ids, an end id after each document. A shard becomes one file: its distinct ids, the most frequent first, then
bit-planes of the places in that list, from the highest bit down, each a stable partition of the one above, with a count of ones
before each block of 512 bits. Frequent ids have small places, so the high planes are nearly all zeros and compress well. From that file
alone `WaveletMatrix` gives the id at a place (rank), counts an id in a range (rank), finds its occurrences (select), and restores all ids.

File format, little-endian: b"WMTX", version, planes, documents, distinct ids (u32 each), ids (u64); the distinct ids (u32); for each plane
the number of zero bits (u64) and the size of its compressed bits (u32); doc_id of each document (i64), a byte each that is 1 if doc_id
is null, the end of each document (u64); for each plane the counts of ones (u32 per block), then its bits (8 to a byte, lowest first, padded
to whole blocks) as one zstd frame. Spark has no writer of raw files, so a file travels as one row (part, before, n_ids, file)
of a Parquet table in the shared folder; `read_shards` reads that table.

Scale: texts are shuffled once, to ranges of (doc_id, hash of the text, row), so neither null nor repeated doc_id gather in one task. A task
holds one shard and a slice of text. The place of a shard's first id is the sum of its part's earlier ids, kept with the file, and of all
parts before it; of these sums there is one for each task.

Defined results: a null text is empty and gives the end id alone; null doc_id come first, repeated doc_id in the order of
their texts' hashes, each a document of its own; an empty table gives no shards; only doc_id and text are read. A special token that a text
spells out, <|endoftext|>, is its one id, as the library has it by default and op8_token_shards gives it; with plain_specials it is text like any other.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import buffers, run_hashes, shared_folder, slices, table

MODEL = "byte_bpe_50k.json"
#: Ids after which a shard ends, at a document's end.
SHARD_IDS = 1 << 19
#: Bytes of text in a task's range: up to PART_BYTES where there are many, fewer to keep all cores busy.
PART_BYTES, LEAST_PART_BYTES = 128 << 20, 8 << 20
#: Slots in which a worker remembers the ids of words; a word has two, and one that finds both taken takes the second.
SLOTS = 1 << 21
BLOCK = 512
#: Parts up to which the list of their first places is broadcast.
BASES = 1_000_000
_HEAD = struct.Struct("<4sIIIIQ")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WaveletMatrix:
    """Bit-planes of the places that ids have in alphabet; packed planes are unpacked when first used."""

    def __init__(self, alphabet: np.ndarray, packed: list[bytes], zeros: list[int], n: int, ranks: list[np.ndarray]):
        self.alphabet, self.packed, self.zeros, self.n, self.ranks = alphabet, packed, zeros, n, ranks
        self._open: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
        used = np.flatnonzero(counts)
        alphabet = used[np.argsort(-counts[used], kind="stable")].astype(np.uint32)
        place = np.zeros(len(counts), ids.dtype)
        place[alphabet] = np.arange(len(alphabet))
        codes, planes = place[ids], max(1, int(len(alphabet) - 1).bit_length())
        packed, zeros, ranks = [], [], []
        for p in range(planes - 1, -1, -1):
            one = (codes & codes.dtype.type(1 << p)) != 0
            bits = np.packbits(one, bitorder="little")
            bits = np.concatenate([bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)])
            ones = np.bitwise_count(bits.reshape(-1, BLOCK // 8)).sum(1, dtype=np.uint32)
            packed.append(pa.compress(bits, "zstd", asbytes=True))
            ranks.append((np.cumsum(ones, dtype=np.uint32) - ones).astype(np.uint32))
            high = np.flatnonzero(one)
            zeros.append(len(codes) - len(high))
            if p:
                codes = np.concatenate([codes[np.flatnonzero(~one)], codes[high]])  # much faster than by masks
        return cls(alphabet, packed, zeros, len(ids), ranks)

    def bits(self, p: int) -> np.ndarray:
        if p not in self._open:
            self._open[p] = np.frombuffer(pa.decompress(self.packed[p], len(self.ranks[p]) * BLOCK // 8, "zstd"), np.uint8)
        return self._open[p]

    def _bit(self, p: int, at: np.ndarray) -> np.ndarray:
        return self.bits(p)[at >> 3] >> (at & 7).astype(np.uint8) & 1

    def _ones(self, p: int, at: np.ndarray) -> np.ndarray:
        """Ones of plane p before each place (rank)."""
        at = np.asarray(at, np.int64)
        if not self.n:
            return np.zeros(at.shape, np.int64)
        block = np.minimum(at // BLOCK, len(self.ranks[p]) - 1)
        first = block * (BLOCK // 8)
        cells = first[..., None] + np.arange(BLOCK // 8)
        inside = np.clip(at[..., None] - cells * 8, 0, 8)
        part = np.bitwise_count(self.bits(p)[cells] & ((1 << inside) - 1).astype(np.uint8)).sum(-1, dtype=np.int64)
        return self.ranks[p][block].astype(np.int64) + part

    def _select(self, p: int, nth: np.ndarray, one: bool) -> np.ndarray:
        """Where plane p has its nth (from 0) one or zero: the block by its count, the place inside it by its bits."""
        before = self.ranks[p].astype(np.int64)
        if not one:
            before = np.arange(len(before)) * BLOCK - before
        block = np.searchsorted(before, nth, side="right") - 1
        rows = np.unpackbits(self.bits(p).reshape(-1, BLOCK // 8)[block], axis=1, bitorder="little")
        seen = np.cumsum(rows == one, axis=1, dtype=np.int16)
        return block * BLOCK + (seen <= (nth - before[block])[:, None]).sum(1)

    def access(self, at: np.ndarray) -> np.ndarray:
        at, out = np.asarray(at, np.int64), np.zeros(np.shape(at), np.int64)
        for p in range(len(self.packed)):
            one, before = self._bit(p, at), self._ones(p, at)
            out = out << 1 | one
            at = np.where(one == 1, self.zeros[p] + before, at - before)
        return self.alphabet[out].astype(np.int64)

    def _place(self, token: int) -> int | None:
        found = np.flatnonzero(self.alphabet == token)
        return int(found[0]) if len(found) else None

    def _range(self, code: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences in [lo, hi) of the id with that code lie on the last level."""
        for p in range(len(self.packed)):
            before = self._ones(p, np.array([lo, hi]))
            lo, hi = (self.zeros[p] + before).tolist() if code >> (len(self.packed) - 1 - p) & 1 else (np.array([lo, hi]) - before).tolist()
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        code = self._place(token)
        if code is None:
            return 0
        a, b = self._range(code, lo, self.n if hi is None else hi)
        return b - a

    def locate(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Places of the occurrences in [lo, hi), by select from the last level up."""
        code, found = self._place(token), []
        a, b = (0, 0) if code is None else self._range(code, lo, self.n if hi is None else hi)
        for first in range(a, b, 4096):
            at = np.arange(first, min(b, first + 4096))
            for p in range(len(self.packed) - 1, -1, -1):
                one = bool(code >> (len(self.packed) - 1 - p) & 1)
                at = self._select(p, at - self.zeros[p] if one else at, one)
            found.append(at)
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def ids(self) -> np.ndarray:
        """All ids in order: each plane, from the last, puts the values below it back in their places."""
        kind = np.uint16 if len(self.packed) <= 16 else np.uint32
        value = np.zeros(self.n, kind)
        for p in range(len(self.packed) - 1, -1, -1):
            one = np.unpackbits(self.bits(p), count=self.n, bitorder="little").view(bool)
            above = np.empty_like(value)
            above[np.flatnonzero(~one)] = value[: self.zeros[p]]
            above[np.flatnonzero(one)] = value[self.zeros[p] :] | kind(1 << (len(self.packed) - 1 - p))
            value = above
        return self.alphabet[value]


def pack(ids: np.ndarray, doc_ids: np.ndarray, nulls: np.ndarray, ends: np.ndarray) -> bytes:
    m = WaveletMatrix.of(ids)
    parts = [_HEAD.pack(b"WMTX", 2, len(m.packed), len(doc_ids), len(m.alphabet), m.n), m.alphabet.astype("<u4").tobytes(), np.asarray(m.zeros, "<u8").tobytes()]
    parts += [np.array([len(x) for x in m.packed], "<u4").tobytes(), doc_ids.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), ends.astype("<u8").tobytes()]
    for rank, bits in zip(m.ranks, m.packed, strict=True):
        parts += [rank.astype("<u4").tobytes(), bits]
    return b"".join(parts)


def unpack(file: bytes) -> tuple[WaveletMatrix, np.ndarray, np.ndarray, np.ndarray]:
    """The matrix, and doc_id, null mark and end of each document."""
    magic, version, planes, docs, distinct, n = _HEAD.unpack_from(file)
    if magic != b"WMTX" or version != 2:
        raise ValueError("not a token shard")
    at = _HEAD.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(file, kind, count, at)
        at += out.nbytes
        return out

    alphabet, zeros, sizes = take("<u4", distinct), take("<u8", planes), take("<u4", planes)
    doc_ids, nulls, ends = take("<i8", docs), take("u1", docs), take("<u8", docs)
    ranks, packed = [], []
    for size in sizes.tolist():
        ranks.append(take("<u4", -(-n // BLOCK)))
        packed.append(file[at : at + size])
        at += size
    return WaveletMatrix(alphabet, packed, [int(z) for z in zeros], n, ranks), doc_ids, nulls, ends


class Encoder:
    """The library's ids of many texts at once; each distinct word of a slice is encoded once.

    A text is cut where a space follows a printable ASCII or a Latin letter: the tokenizer's own pattern never joins what stands on the two
    sides, as its pieces hold white space only at their start. Bytes of each id are known, so ids of the
    distinct words, encoded as one text, are split among the words by their lengths.
    """

    def __init__(self, model: str, plain_specials: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and threads cost memory
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model)
        self.model.encode_special_tokens = plain_specials
        pieces = sorted(self.model.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.width = np.zeros(pieces[-1][1] + 1, np.int64)
        for piece, i in pieces:
            self.width[i] = len(piece)
        self.name = np.zeros(SLOTS, np.uint64)  # of the word in each slot, 0 for none
        self.first, self.many = np.zeros(SLOTS, np.int32), np.zeros(SLOTS, np.int32)
        self.flat, self.used = np.zeros(8 * SLOTS, np.uint16 if len(self.width) <= 1 << 16 else np.uint32), 0

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's end."""
        data, at = buffers(texts)
        if not len(data):
            return self.flat[:0], np.zeros(len(at) - 1, np.int64)
        plain = (data > 32) & (data < 127)
        plain[1:] |= data[:-1] == 0xC3
        cut = np.zeros(len(data) + 1, bool)
        cut[1:-1] = (data[1:] == 32) & plain[:-1]
        cut[at] = True
        border = np.flatnonzero(cut).astype(np.int64)
        start, end = border[:-1], border[1:]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(border), pa.py_buffer(data)])
        name = run_hashes(data, start, end - start)
        slot = (name & np.uint64(SLOTS - 1)).astype(np.int64)
        lost = np.flatnonzero(self.name[slot] != name)
        slot[lost] = (name[lost] >> np.uint64(40) & np.uint64(SLOTS - 1)).astype(np.int64)
        first, many = self.first[slot].astype(np.int64), self.many[slot].astype(np.int64)
        new = lost[self.name[slot[lost]] != name[lost]]
        if len(new):
            distinct, some, which = np.unique(name[new], return_index=True, return_inverse=True)
            some = new[some]
            f, m = self._learn(words.take(pa.array(some)), (end - start)[some], (data[start[some]] == 32) & plain[end[some] - 1])
            first[new], many[new] = f[which], m[which]
            home = (distinct & np.uint64(SLOTS - 1)).astype(np.int64)
            slot = np.where(self.name[home] == 0, home, slot[some])
            self.name[slot], self.first[slot], self.many[slot] = distinct, f, m
        out = self.flat[np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))]
        total = np.concatenate([[0], np.cumsum(many)])
        ends = total[np.searchsorted(border, at[1:])]
        if self.used > 7 * SLOTS:
            self.name[:], self.used = 0, 0
        return out, ends

    def _learn(self, words: pa.Array, long: np.ndarray, regular: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in flat the ids of each word begin, and how many they are.

        regular words begin with a space and end before a cut, so they can stand side by side in one text.
        """
        joined, total = b"".join(words.filter(pa.array(regular)).to_pylist()), np.cumsum(long[regular])
        other = [w.decode() for w in words.filter(pa.array(~regular)).to_pylist()]
        made = self.model.encode_batch_fast([joined.decode(), *other], add_special_tokens=False)
        ids = np.asarray(made[0].ids, self.flat.dtype)
        last = np.searchsorted(np.cumsum(self.width[ids]), total)
        last = np.concatenate([last + 1, len(ids) + np.cumsum([len(x.ids) for x in made[1:]], dtype=np.int64)])
        flat = np.concatenate([ids, *[np.asarray(x.ids, self.flat.dtype) for x in made[1:]]])
        order = np.argsort(np.concatenate([np.flatnonzero(regular), np.flatnonzero(~regular)]))
        if not (np.cumsum(self.width[flat])[last - 1] == np.cumsum(np.concatenate([long[regular], long[~regular]]))).all():
            raise ValueError("the ids do not tile the words")
        start = np.concatenate([[0], last[:-1]])
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(flat), len(self.flat)), self.flat.dtype)])
        self.flat[self.used : self.used + len(flat)] = flat
        start, self.used = start + self.used, self.used + len(flat)
        return start[order], (last - np.concatenate([[0], last[:-1]]))[order]


@lru_cache(2)
def _encoder(model: str, plain_specials: bool = True) -> Encoder:
    return Encoder(model, plain_specials)


def _ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in ascending order of doc_id over partitions and inside them; ties by hash of the text, then by row."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    cores = docs.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-size // PART_BYTES), min(-(-size // LEAST_PART_BYTES), 4 * cores))
    order = ["doc_id", "tie", "row"]
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")


def write_shards(docs: DataFrame, folder: str, path: str | None = None, shard_ids: int = SHARD_IDS, plain_specials: bool = True, end_id: int = 0) -> None:
    """Encode docs(doc_id, text) and write their shards to folder as rows (part, before, n_ids, file); before counts the part's earlier ids."""
    model = Path(path or model_path()).read_text()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = _encoder(model, plain_specials), TaskContext.get().partitionId(), 0
        kind = np.uint16 if len(encoder.width) <= 1 << 16 else np.uint32
        held: list[tuple[np.ndarray, ...]] = []

        def shard() -> pa.RecordBatch:
            nonlocal before
            ids, doc_ids, nulls, long = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            made = [pa.array([part]), pa.array([before]), pa.array([len(ids)]), pa.array([pack(ids, doc_ids, nulls, np.cumsum(long))], pa.binary())]
            before += len(ids)
            return pa.RecordBatch.from_arrays(made, ["part", "before", "n_ids", "file"])

        for batch in slices(batches):
            ids, ends = encoder(batch.column("text"))
            ids = np.insert(ids, ends, end_id).astype(kind, copy=False)
            ends = ends + np.arange(1, len(ends) + 1)
            held.append((ids, np.asarray(batch.column("doc_id").fill_null(0), np.int64), np.asarray(batch.column("doc_id").is_null()), np.diff(ends, prepend=0)))
            if sum(len(x[0]) for x in held) >= shard_ids:
                yield shard()
        if held:
            yield shard()

    _ranges(docs).mapInArrow(run, "part bigint, before bigint, n_ids bigint, file binary").write.option("compression", "none").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """(part, n_ids, base, file): base is the number of ids in all shards before it.

    The ids of each part are summed where they lie; the list of these sums, 16 bytes for each task that wrote, is put in order by one window. Up
    to BASES of them it is broadcast, beyond that joined by a shuffle.
    """
    files = spark.read.parquet(folder)
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("all_ids"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", F.coalesce(F.sum("all_ids").over(earlier), F.lit(0)).alias("first"))
    if sums.count() <= BASES:
        bases = F.broadcast(bases)
    return files.join(bases, "part").select("part", "n_ids", (F.col("first") + F.col("before")).alias("base"), "file")


_OUTPUTS = {"ids": "array<int>", "n_tokens": "bigint", "ids_crc32": "bigint"}


def documents_of(shards: DataFrame, outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """(doc_id, start, *outputs) of every document, restored from the files; ids_crc32 is of ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, file in zip(batch.column("base").to_pylist(), batch.column("file"), strict=True):
                m, doc_ids, nulls, ends = unpack(file.as_py())
                ids = m.ids().view("<i4")
                at = np.concatenate([[0], ends.astype(np.int64)])
                made = {
                    "ids": lambda ids=ids, at=at: pa.LargeListArray.from_arrays(pa.array(at), pa.array(ids)).cast(pa.list_(pa.int32())),
                    "n_tokens": lambda at=at: pa.array(np.diff(at)),
                    "ids_crc32": lambda ids=ids, at=at: pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                }
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=nulls.astype(bool)), pa.array(base + at[:-1]), *(made[o]() for o in outputs)], ["doc_id", "start", *outputs])

    return shards.select("base", "file").mapInArrow(run, "doc_id bigint, start bigint, " + ", ".join(f"{o} {_OUTPUTS[o]}" for o in outputs))


def count_ids(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n) for the stated ids over all shards, by rank queries alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file"):
                m = unpack(file.as_py())[0]
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int32()), pa.array([m.count(t) for t in tokens], pa.int64())], ["token", "n"])

    return shards.select("file").mapInArrow(run, "token int, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def locate_id(shards: DataFrame, token: int) -> DataFrame:
    """(at): every place, counted over all shards, that holds the id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, file in zip(batch.column("base").to_pylist(), batch.column("file"), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(base + unpack(file.as_py())[0].locate(token))], ["at"])

    return shards.select("base", "file").mapInArrow(run, "at bigint")


def op8_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, plain_specials=False)
    return documents_of(read_shards(spark, folder), ("n_tokens", "ids_crc32"))


QUERIES = {"op8_token_shards": op8_token_shards}
ORACLE_SQL: dict[str, str] = {}
