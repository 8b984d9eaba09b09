import hashlib

import sentencepiece
import test_decontamination
import test_minhash_dedup
import test_secret_scan

import corpus_pipeline as P
from folioquery.llm import sentence_pieces, toxicity
from folioquery.llm.common import table

SF = "/root/testdata/sf0.01"


def redact(text):
    out, at = "", 0
    for kind, a, b in test_secret_scan.all_spans(text):
        out += text[at : max(at, a)] + (f"[{kind}]" if b > at else "")
        at = max(at, b)
    return out + text[at:]


def test_stages_against_brute_force(spark):
    docs = table(spark, SF, "documents").cache()
    rows = {r["doc_id"]: r for r in docs.collect()}
    state, kept = docs, dict(rows)
    for name, stage in P.STAGES[:-1]:
        state = stage(spark, state, SF)
        assert state.columns == docs.columns
        state = spark.createDataFrame(state.collect(), docs.schema)
        now = {r["doc_id"]: r for r in state.collect()}
        assert len(now) == state.count()
        if name == "toxicity":
            bad = {r["doc_id"] for r in toxicity.score(docs, toxicity.model_for(spark, docs, SF)).collect() if r["predicted"]}
            kept = {i: r for i, r in kept.items() if i not in bad}
            assert bad and len(bad) < 0.15 * len(rows)
        elif name == "minhash_near_dedup":
            kept = {i: kept[i] for i, _, _, keep in test_minhash_dedup.expected([(i, r["text"]) for i, r in kept.items()], 80) if keep}
        elif name == "benchmark_decontamination":
            order = [(i, r["text"]) for i, r in kept.items()]
            items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
            leaks = {order[row][0] for row, _ in test_decontamination.expected(order, items)}
            kept = {i: r for i, r in kept.items() if i not in leaks}
            assert leaks
        else:
            assert any(redact(r["text"]) != r["text"] for r in kept.values())
            assert {i: (r["text"], r["n_chars"], r["lang"]) for i, r in now.items()} == {i: (t := redact(r["text"]), len(t), r["lang"]) for i, r in kept.items()}
        assert set(now) == set(kept), name
    lib = sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.model_path())
    out = P.STAGES[-1][1](spark, state, SF).collect()
    assert {r["doc_id"] for r in out} == set(kept)
    for r in out:
        text = now[r["doc_id"]]["text"]
        assert r["ids"] == lib.encode(text, add_bos=True, add_eos=True) and r["n_tokens"] == len(r["ids"]) == len(r["starts"]) == len(r["ends"])
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(r["ids"]).encode()).hexdigest()
    assert {(r["doc_id"], r["n_tokens"]) for r in P.run(spark, SF).collect()} == {(r["doc_id"], r["n_tokens"]) for r in out}


def test_odd_rows_pass_all_stages(spark):
    schema = table(spark, SF, "documents").schema
    rows = [(None, None, None, None, None), (10**9, "", "en", "s", 0), (10**9 + 1, "long " * 30_000, "en", "s", 150_000), (10**9 + 2, "password=abcdef", None, None, 15), (10**9 + 2, "password=abcdef", None, None, 15)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in P.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), schema)
        assert docs.count() == len(rows)
        assert all(stage(spark, docs.limit(0), SF).count() == 0 for _, stage in P.STAGES)
    assert sorted(r["text"] or "" for r in docs.collect())[2:4] == ["[assign]", "[assign]"]
    assert P.STAGES[-1][1](spark, docs, SF).count() == len(rows)


def test_extra_columns_with_clashing_names_stay(spark):
    docs = table(spark, SF, "documents").limit(60)
    extra = ["key", "k", "t", "text_name", "blob", "spans", "_spans", "c1", "cluster", "score", "label", "_hub", "n", "row"]
    odd = docs.selectExpr("*", *[f"concat('{c}', doc_id) AS `{c}`" for c in extra])
    for _, stage in P.STAGES[:-1]:
        odd = stage(spark, odd, SF)
        assert odd.columns == [*docs.columns, *extra]
        odd = spark.createDataFrame(odd.collect(), odd.schema)
    rows = odd.collect()
    assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in extra)
