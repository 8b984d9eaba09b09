import hashlib

import numpy as np
import pytest
import sentencepiece

from folioquery.llm import sentence_pieces as S
from folioquery.llm.common import table

TEXTS = ["", None, " ", "  a  b ", "Hello  world", "ü😀　x\t\n\r y", "<s>x</s><unk>", "▁▁a", "ﬁ Ⅷ ½ ａ", "é", "a" * 50_000, "漢字かな交じり", " ​", "\x00\x01"]


def test_ids_text_and_spans(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=S.model_path())
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate(TEXTS)] + [(None, "x", [1]), (0, "again", [1])], "doc_id long, text string, ids array<int>")
    out = S.encode(docs, outputs=("ids", "starts", "ends", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect()
    assert len(out) == len(TEXTS) + 2
    for r, text in zip(out, [*TEXTS, "x", "again"]):
        text = text or ""
        assert r["ids"] == lib.encode(text, add_bos=True, add_eos=True)
        assert r["decoded"] == lib.decode(r["ids"]) and r["n_tokens"] == len(r["ids"])
        assert r["ids_sha256"] == hashlib.sha256(np.asarray(r["ids"], "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
        raw = text.encode()
        assert b"".join(raw[a:b] for a, b in zip(r["starts"], r["ends"])) == raw
        assert all(a <= b for a, b in zip(r["starts"], r["ends"]))
    assert S.encode(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rule", ["nfkc", "nmt_nfkc", "nfkc_cf", "nmt_nfkc_cf"])
def test_normalisation_by_compiled_map(rule):
    """Against the library's own normaliser, and its offsets, for maps that do change texts."""
    for flags in ({}, {"remove_extra_whitespaces": True}, {"remove_extra_whitespaces": True, "add_dummy_prefix": True, "escape_whitespaces": True}):
        lib = sentencepiece.SentencePieceNormalizer(rule_name=rule, **flags)
        mine = S.Normalizer(lib.serialized_model_proto())
        for text in TEXTS + ["  ﬁ  ①  x  ", "Ａ　Ｂ", "ﷺ", "  "]:
            normal, source = mine((text or "").encode())
            want, offsets = lib.normalize(text or "", with_offsets=True)
            assert normal.decode() == want, (text, flags)
            at = np.cumsum([0] + [len(c.encode()) for c in want])
            chars = [len((text or "").encode()[: source[i]].decode()) for i in at]
            assert chars == list(offsets), (text, flags)


def spans_of(lib, text, ids):
    """Source bytes of each id, by walking the pieces over the text; a leading mark and the begin and end ids have none of their own."""
    raw, at, out = text.encode(), 0, []
    for n, i in enumerate(ids):
        begin = at
        if not lib.is_control(i):
            piece = lib.id_to_piece(i)
            size = 1 if lib.is_byte(i) else len(piece.replace("▁", " ").encode()) if "▁" not in text else None
            assert size is not None
            if n == 1:  # the first piece begins with the mark that is put before every text
                size -= 1
            at += size
        out.append((begin, at))
    assert at == len(raw)
    return out


def test_query_equals_library(spark):
    sf = "/root/testdata/sf0.001"
    lib = sentencepiece.SentencePieceProcessor(model_file=S.model_path())
    docs = {r["doc_id"]: r["text"] or "" for r in table(spark, sf, "documents").collect()}
    out = {r["doc_id"]: r for r in S.op6_sentence_pieces(spark, sf).collect()}
    assert set(out) == set(docs)
    for d, text in docs.items():
        ids, row = lib.encode(text, add_bos=True, add_eos=True), out[d]
        digest = lambda values: hashlib.sha256(np.asarray(values, "<u4").tobytes()).hexdigest()
        assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), digest(ids))
        assert row["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
        assert row["spans_sha256"] == digest([x for span in spans_of(lib, text, ids) for x in span])
