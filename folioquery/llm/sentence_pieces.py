"""SentencePiece encoding and decoding with offsets.

A text is normalised as the model says: at each place the longest prefix that the compiled character map knows is
replaced by its image, other characters stay; white space is marked; and for every normalised byte the source byte
it came from is kept. The library's ids tile the normalised bytes, so each piece projects to a span of source bytes.

Scale: one pass over the rows without a shuffle; a task holds about a megabyte of text, or one longer text. The model
(half a megabyte here) travels in the tasks; its size does not grow with the data.

Defined results: a null text is empty; an empty text has the begin and end ids alone and decodes to an empty text; rows with
null or repeated doc_id keep a row each; an empty table gives an empty table; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

MODEL = "piece_bpe_32k.model"
_MARK = "▁".encode()
_OUTPUTS = {"ids": "array<int>", "starts": "array<int>", "ends": "array<int>", "decoded": "string", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string", "spans_sha256": "string"}


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a serialised message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = message[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(message):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, message[at : at + n]
            at += n


class CharacterMap:
    """The compiled map: a double-array trie over source prefixes, and the images, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = struct.unpack(f"<{size // 4}I", blob[4 : 4 + size])
        self.images = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[bytes, int] | None:
        """The image of the longest known prefix of text[at:], and how many bytes it takes."""
        units, found, node = self.units, None, 0
        node ^= (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, i + 1 - at
        if found is None:
            return None
        return self.images[found[0] : self.images.index(b"\0", found[0])], found[1]


class Normalizer:
    """Normalised bytes of a text, and for each of them (and the end) the source byte at which it begins."""

    def __init__(self, model: bytes):
        spec = dict(_fields(next((v for k, v in _fields(model) if k == 3), b"")))
        trainer = dict(_fields(next((v for k, v in _fields(model) if k == 2), b"")))
        self.map = CharacterMap(spec[2]) if spec.get(2) else None
        self.prefix, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.suffix = bool(trainer.get(24, 0))

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if not text:
            return b"", np.zeros(1, np.int64)
        if self.map is None and not self.squeeze and not self.suffix:
            return self._plain(text)
        return self._mapped(text)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        space = _MARK if self.escape else b" "
        raw = np.frombuffer(text, np.uint8)
        width = np.where(raw == 32, len(space), 1)
        source = np.repeat(np.arange(len(raw)), width)
        head = np.zeros(len(space) * self.prefix, np.int64)
        return space * self.prefix + text.replace(b" ", space), np.concatenate([head, source, [len(raw)]])

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        def next_piece(at: int) -> tuple[bytes, int]:
            found = self.map.longest(text, at) if self.map else None
            if found:
                return found
            n = 1
            while at + n < len(text) and text[at + n] & 0xC0 == 0x80:
                n += 1
            return text[at : at + n], n

        space, out, source, at = _MARK if self.escape else b" ", bytearray(), [], 0
        while self.squeeze and at < len(text):
            image, n = next_piece(at)
            if image.replace(b" ", b""):
                break
            at += n
        if at == len(text):
            return b"", np.zeros(1, np.int64)
        after_space = self.squeeze
        if self.prefix and not self.suffix:
            out += space
            source += [at] * len(space)
        while at < len(text):
            image, n = next_piece(at)
            if after_space:
                image = image.lstrip(b" ")
            if image:
                written = image.replace(b" ", space) if self.escape else image
                out += written
                source += [at] * len(written)
                after_space = self.squeeze and image.endswith(b" ")
            at += n
        while self.squeeze and out.endswith(space):
            del out[-len(space) :]
            at = source[-len(space)]
            del source[-len(space) :]
        if self.prefix and self.suffix:
            out += space
            source += [at] * len(space)
        return bytes(out), np.asarray([*source, at])


class Codec:
    def __init__(self, model: bytes):
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalize = Normalizer(model)
        n = self.pieces.get_piece_size()
        plain = [not self.pieces.is_control(i) for i in range(n)]
        self.width = np.array([1 if self.pieces.is_byte(i) else len(self.pieces.id_to_piece(i).encode()) * plain[i] for i in range(n)])

    def spans(self, text: str, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Source bytes of each id; begin and end ids have empty spans."""
        normal, source = self.normalize(text.encode())
        width = self.width[ids]
        if width.sum() != len(normal):  # unknown pieces have no width of their own
            proto = self.pieces.encode(text, out_type="immutable_proto", add_bos=True, add_eos=True)
            width = np.array([0 if self.pieces.is_control(p.id) else 1 if self.pieces.is_byte(p.id) else len(p.piece.encode()) for p in proto.pieces])
        end = np.cumsum(width)
        if end[-1] != len(normal):
            raise ValueError("the pieces do not tile the normalised text")
        return source[end - width], source[end]


@lru_cache(2)
def _codec(model: bytes) -> Codec:
    return Codec(model)


def encode(docs: DataFrame, path: str | None = None, outputs: tuple[str, ...] = ("ids", "starts", "ends", "decoded")) -> DataFrame:
    """doc_id and outputs of each row of docs(doc_id, text): ids with begin and end, the source byte span of each id, the
    text decoded from ids, and digests of these (ids, and starts and ends in turn, as little-endian 32-bit integers)."""
    model = Path(path or model_path()).read_bytes()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for batch in slices(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = codec.pieces.encode(texts, num_threads=1, add_bos=True, add_eos=True)
            decoded = codec.pieces.decode(ids, num_threads=1)
            spans = [codec.spans(t, i) for t, i in zip(texts, ids, strict=True)]
            made = {
                "ids": lambda: pa.array(ids, pa.list_(pa.int32())),
                "starts": lambda: pa.array([a for a, _ in spans], pa.list_(pa.int32())),
                "ends": lambda: pa.array([b for _, b in spans], pa.list_(pa.int32())),
                "decoded": lambda: pa.array(decoded, pa.string()),
                "n_tokens": lambda: pa.array([len(i) for i in ids], pa.int64()),
                "ids_sha256": lambda: pa.array([hashlib.sha256(np.asarray(i, "<u4").tobytes()).hexdigest() for i in ids]),
                "spans_sha256": lambda: pa.array([hashlib.sha256(np.stack(s, 1).astype("<u4").tobytes()).hexdigest() for s in spans]),
                "decoded_sha256": lambda: pa.array([hashlib.sha256(d.encode()).hexdigest() for d in decoded]),
            }
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(made[o]() for o in outputs)], ["doc_id", *outputs])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, " + ", ".join(f"{o} {_OUTPUTS[o]}" for o in outputs))


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), outputs=("n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256"))


QUERIES = {"op6_sentence_pieces": op6_sentence_pieces}
ORACLE_SQL: dict[str, str] = {}
