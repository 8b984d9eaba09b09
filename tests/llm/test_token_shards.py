import random
import zlib

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from folioquery.llm import token_shards as T
from folioquery.llm.common import table


def lib():
    t = Tokenizer.from_file(T.model_path())
    t.encode_special_tokens = True
    return t


TEXTS = ["", None, " ", "  ", "a", "a  b", "don't  'll <|endoftext|> x", "ü é  ß  b", "\n\n a\n", "　全角 スペース ", "x  y", "a" * 3000, "tab\t tab", " end ", "1234 5678  9", "é ", "😀 😀", "\x85 a", "b\x85 a"]


def test_encoder_equals_library():
    r, own, encoder = random.Random(5), lib(), T.Encoder(open(T.model_path()).read())
    bits = ["foo", "bar's", " ", "  ", "\n", "ü", "漢", " ", "12", "!", "\t", "Foo", "　", "é"]
    for _ in range(6):
        texts = [*TEXTS, *("".join(r.choice(bits) for _ in range(r.randrange(30))) for _ in range(200))]
        ids, ends = encoder(pa.array(texts, pa.string()))
        got = [x.tolist() for x in np.split(ids, ends[:-1])]
        assert got == [e.ids for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_wavelet_matrix_against_arrays():
    r = np.random.default_rng(1)
    for n, top in ((0, 1), (1, 1), (511, 3), (512, 2), (5000, 50257), (1500, 1)):
        ids = r.integers(0, top, n).astype(np.uint32)
        m = T.unpack(T.pack(ids, np.array([5]), np.array([0]), np.array([n])))[0]
        assert (m.ids() == ids).all()
        at = np.arange(n)
        assert (m.access(at) == ids).all()
        for t in [0, 1, top, *ids[:5].tolist()]:
            assert (m.locate(t) == np.flatnonzero(ids == t)).all()
            for lo, hi in ((0, n), (n // 3, n // 2)):
                assert m.count(t, lo, hi) == (ids[lo:hi] == t).sum()


def test_shards_in_order(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, t, "c") for i, t in enumerate(TEXTS)] + [(None, "null id", "c"), (3, "again", "c"), (3, "again", "c"), (-5, "first", "c")]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    own = lib()
    turn = {x["text"]: x["h"] for x in docs.selectExpr("text", "xxhash64(text) AS h").collect()}
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, turn[x[1]]))
    encoded = [(d is not None, d or 0, own.encode(t or "", add_special_tokens=False).ids + [0]) for d, t, _ in ordered]
    stream = [i for _, _, ids in encoded for i in ids]
    for size in (64, 1 << 20):
        folder = str(tmp_path / f"s{size}")
        T.write_shards(docs, folder, shard_ids=size)
        shards = T.read_shards(spark, folder)
        out = sorted(T.documents_of(shards).collect(), key=lambda x: x["start"])
        assert [i for x in out for i in x["ids"]] == stream
        assert [x["doc_id"] for x in out] == [d if has else None for has, d, _ in encoded]
        assert [x["start"] for x in out] == np.cumsum([0, *(len(x[2]) for x in encoded)])[:-1].tolist()
        assert {x["token"]: x["n"] for x in T.count_ids(shards, [0, stream[0], 50000]).collect()} == {t: stream.count(t) for t in (0, stream[0], 50000)}
        assert sorted(x["at"] for x in T.locate_id(shards, stream[0]).collect()) == [i for i, x in enumerate(stream) if x == stream[0]]
    T.write_shards(docs.limit(0), str(tmp_path / "none"))
    assert T.documents_of(T.read_shards(spark, str(tmp_path / "none"))).count() == 0


def test_rows_without_id_or_with_one_id_lie_in_many_parts(spark, tmp_path):
    docs = spark.range(4000).selectExpr("CASE WHEN id % 3 = 0 THEN 7L END AS doc_id", "CASE WHEN id % 2 = 0 THEN 'same words here' ELSE concat('word ', id) END AS text")
    T.write_shards(docs, str(tmp_path / "s"), shard_ids=500)
    shards = T.read_shards(spark, str(tmp_path / "s"))
    assert shards.agg({"n_ids": "max"}).first()[0] < 20_000
    assert T.documents_of(shards, ("n_tokens",)).groupBy("doc_id").count().orderBy("doc_id").collect() == [(None, 2666), (7, 1334)]
    out = T.documents_of(shards, ("n_tokens",)).orderBy("start").collect()
    assert [x["start"] for x in out] == np.cumsum([0, *(x["n_tokens"] for x in out)])[:-1].tolist()


def test_long_text_is_one_shard(spark, tmp_path):
    text = "many words, and more " * 120_000  # longer than a slice
    T.write_shards(spark.createDataFrame([(1, "a"), (2, text), (3, "b")], "doc_id long, text string"), str(tmp_path / "s"), shard_ids=100)
    own = lib()
    out = T.documents_of(T.read_shards(spark, str(tmp_path / "s"))).orderBy("start").collect()
    assert [x["ids"] for x in out] == [own.encode(t, add_special_tokens=False).ids + [0] for t in ("a", text, "b")]


def test_query_against_library(spark):
    own, at = lib(), 0
    docs = {r["doc_id"]: r["text"] for r in table(spark, "/root/testdata/sf0.001", "documents").collect()}
    out = {r["doc_id"]: r for r in T.op8_token_shards(spark, "/root/testdata/sf0.001").collect()}
    for d in sorted(docs):
        ids = own.encode(docs[d] or "", add_special_tokens=False).ids + [0]
        assert (out[d]["start"], out[d]["n_tokens"], out[d]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)


def test_special_token_in_a_text_is_its_one_id(spark, tmp_path):
    r, own, encoder = random.Random(6), Tokenizer.from_file(T.model_path()), T.Encoder(open(T.model_path()).read(), plain_specials=False)
    special = "<|endoftext|>"
    assert own.encode("a " + special + " b", add_special_tokens=False).ids[2:3] == [50256]
    bits = [special, special, "<|endof", "text|>", "a", "it's", " ", "  ", "\n", "\u00fc", "\u6f22", "!", "12"]
    texts = [*TEXTS, special, f"a {special} b", *("".join(r.choice(bits) for _ in range(r.randrange(20))) for _ in range(500))]
    want = [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids, ends = encoder(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == want
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    at = 0
    for x, ids in zip(sorted(T.op8_token_shards(spark, str(tmp_path)).collect(), key=lambda x: x["doc_id"]), want, strict=True):
        assert (x["start"], x["n_tokens"], x["ids_crc32"]) == (at, len(ids) + 1, zlib.crc32(np.asarray([*ids, 0], "<u4").tobytes()))
        at += len(ids) + 1


def mirrored(a="a", b="b", n=1024):
    """Two words that powers of any odd base modulo 2**64 cannot tell apart: the Thue-Morse order of two letters, and its complement."""
    return tuple("".join((a, b)[(i.bit_count() + k) % 2] for i in range(n)) for k in (0, 1))


def test_words_that_cancel_are_told_apart():
    one, two = mirrored()
    texts = [one, two, f" {two} {one}", f" {one} {two}"]
    ids, ends = T.Encoder(open(T.model_path()).read())(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [e.ids for e in lib().encode_batch(texts, add_special_tokens=False)]
