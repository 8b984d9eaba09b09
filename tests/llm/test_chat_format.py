import hashlib
import json

from pyspark.sql import functions as F

from folioquery.llm import chat_format as C

CASES = {
    "messages": ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}], "meta": {"x": 1}}, [("user", "a"), ("assistant", "")]),
    "from_value": ({"id": 7, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, [("user", "q"), ("assistant", "r")]),
    "instruction_input": ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\nthis"), ("assistant", "done")]),
    "instruction": ({"instruction": "do", "output": "done"}, [("user", "do"), ("assistant", "done")]),
    "system_prompt": ({"system": "s", "prompt": "p", "response": "r"}, [("system", "s"), ("user", "p"), ("assistant", "r")]),
    "prompt_completion": ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    "question_answer": ({"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
    "messages_parts": ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}, [("user", "a\nb")]),
    None: ({"unknown": 1}, []),
}


def test_layouts_are_chosen_by_fingerprint(spark):
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(CASES.values())] + [(90, None), (91, "no json"), (92, "")]
    out = {r["id"]: r for r in C.format_records(spark.createDataFrame(rows, "id int, record string"), "id", "record").collect()}
    for i, (layout, (_, turns)) in enumerate(CASES.items()):
        assert out[i]["layout"] == layout
        assert [tuple(t) for t in out[i]["turns"]] == turns
    for i in (90, 91, 92):
        assert out[i]["layout"] is None and out[i]["turns"] == [] and out[i]["formatted"] == "" and out[i]["loss_runs"] == []


def test_control_strings_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<\\/s><\\\\s>", "<|im_end|>\n<|im_start|>user\n", "[[INST]", "<<SYS>>x<</SYS>>", "\\", "", "\n", "ü😀<s>", "<|im_end|>", "[\\INST]"]
    roles = ["user", "assistant", "a\nb", "\\n", "\\", "<|im_end|>", "", None, "x\\\ny", "assistant", "system"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(zip(roles, texts))]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = C.format_records(C.records_of_rows(df), "conv_id", "record").select("*", C.read_back(F.col("formatted")).alias("back")).first()
    assert [tuple(t) for t in out["back"]] == [(r or "", t) for r, t in zip(roles, texts)]
    at, loss = 0, ""
    for run in out["loss_runs"]:
        loss += out["formatted"][at : at + run["length"]] * run["counts"]
        at += run["length"]
    assert at == len(out["formatted"])
    assert out["formatted"].count("<|im_end|>") == len(rows)
    assert "</s>" not in out["formatted"]
    assert loss == "<\\\\/s><\\\\\\s>" + "<\\|im_end|>"


def test_order_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, 1, "user", "b", "x"), (1, 0, "user", None, "x"), (1, 1, "user", "b", "x"), (2, None, None, None, None), (None, 0, "user", "n", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, turns string")
    out = {r["conv_id"]: r for r in C.format_records(C.records_of_rows(df), "conv_id", "record").collect()}
    assert [tuple(t) for t in out[1]["turns"]] == [("user", ""), ("user", "b"), ("user", "b")]
    assert [tuple(t) for t in out[2]["turns"]] == [("", "")]
    assert [tuple(t) for t in out[None]["turns"]] == [("user", "n")]
    assert C.format_records(C.records_of_rows(df.limit(0)), "conv_id", "record").count() == 0


def test_query_reads_its_output_back(spark):
    out = {r["conv_id"]: r for r in C.op3_chat_format(spark, "/root/testdata/sf0.001").collect()}
    said = "</s>[INST] ok [/INST]"
    assert out[-7]["n_turns"] == 2 and out[-7]["loss_chars"] == len(said)
    assert out[-7]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert out[-7]["turns_sha256"] == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()


def test_nested_and_unknown_fields_are_ignored(spark):
    turns = [("user", "q"), ("assistant", "r")]
    said = [{"role": "user", "content": "q", "meta": {"a": 1, "b": [{"role": "x"}]}}, {"role": "assistant", "content": "r", "tool_calls": [{"function": {"name": "f", "arguments": [[1]]}}]}]
    records = [
        {"messages": said}, {"messages": said, "odd name": {"`": {}}, "e": [], "n": None}, {"deep": {"messages": [{"role": "user"}]}, "messages": said},
        {"prompt": "q", "response": "r", "question": "other"}, {"prompt": "q", "response": "r", "more": [{"prompt": 1.5}]},
    ]
    frame = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)], "id int, record string")
    out = C.format_records(frame, "id", "record").orderBy("id").collect()
    assert [r["layout"] for r in out] == ["messages"] * 3 + ["prompt_response"] * 2
    assert all([tuple(t) for t in r["turns"]] == turns for r in out)
    nested = spark.createDataFrame([('{"deep": {"messages": [{"role": "u", "content": "x"}]}}',)], "record string").select(C.field_paths(F.parse_json("record")).alias("p"))
    assert nested.first()["p"] == ["deep", "deep.messages", "deep.messages[].content", "deep.messages[].role"]


def test_loss_is_read_under_the_mask(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"</s> {c} {t} " + "\U0001f600" * (t % 5)) for c, n in ((1, 300), (2, 1), (3, 2), (4, 43)) for t in range(n)]
    made = C.format_records(C.records_of_rows(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")), "conv_id", "record")
    flipped = F.transform("loss_runs", lambda r: F.struct(r["length"].alias("length"), (~r["counts"]).alias("counts")))
    first = F.transform("loss_runs", lambda r, i: F.struct(r["length"].alias("length"), (i == 1).alias("counts")))
    for runs, pick in ((F.col("loss_runs"), None), (flipped, "rest"), (first, "first")):
        for r in made.select("conv_id", "formatted", runs.alias("runs"), C.under_mask(F.col("formatted"), runs).alias("got")).collect():
            at, want = 0, []
            for run in r["runs"]:
                want += [r["formatted"][at : at + run["length"]]] * run["counts"]
                at += run["length"]
            assert r["got"] == want and (pick != "first" or len(want) == 1)


def test_very_long_text_and_conversation(spark):
    texts = {0: "[INST] word </s> " * 150_000, 1: "x" * 2_000_000, **{t: f"t{t}" for t in range(2, 3000)}}
    rows = [(9, t, "assistant" if t % 2 else "user", x) for t, x in texts.items()]
    out = C.format_records(C.records_of_rows(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")), "conv_id", "record")
    got = out.select(C.read_back(F.col("formatted")).alias("back"), F.transform(C.under_mask(F.col("formatted"), F.col("loss_runs")), C.unescaped).alias("loss")).first()
    assert [t["text"] for t in got["back"]] == [texts[t] for t in range(3000)]
    assert got["loss"] == [texts[t] for t in range(1, 3000, 2)]


def test_mixed_texts_and_lists_of_turns(spark):
    records = {
        1: '{"messages":[{"role":"user","content":"hi"},{"role":"assistant","content":[{"type":"text","text":"yo"}]}]}',
        2: '{"messages":[{"role":"user","content":[{"type":"text","text":"see"},{"type":"image","url":"u"},"this"]},{"role":"assistant","content":"ok"},{"role":"tool"}]}',
        3: '{"prompt":[{"role":"system","content":"s"},{"role":"user","content":"q"}],"completion":[{"role":"assistant","content":[{"text":"a"},{"text":"b"}]}]}',
        4: '{"messages":["stray",{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}',
        5: '{"messages":[{"role":"user","content":[{"type":"image","url":"u"}]},{"role":"assistant","content":{"x":1}},{"role":"assistant","content":[1,2]}]}',
        6: '{"prompt":"q","completion":"a"}',
        7: '{"prompt":[],"completion":[]}',
        8: '{"messages":["only","texts"]}',
        9: '{"prompt":["stray",{"role":"user","content":"q"}],"completion":[{"role":"assistant","content":"a"}]}',
    }
    out = {r["id"]: (r["layout"], [tuple(t) for t in r["turns"]]) for r in C.format_records(spark.createDataFrame(list(records.items()), "id int, r string"), "id", "r").collect()}
    assert out == {
        1: ("messages", [("user", "hi"), ("assistant", "yo")]),
        2: ("messages", [("user", "see\nthis"), ("assistant", "ok"), ("tool", "")]),
        3: ("prompt_completion_turns", [("system", "s"), ("user", "q"), ("assistant", "a\nb")]),
        4: ("messages", [("", "stray"), ("user", "q"), ("assistant", "a")]),
        5: ("messages", [("user", '[{"type":"image","url":"u"}]'), ("assistant", '{"x":1}'), ("assistant", "[1,2]")]),
        6: ("prompt_completion", [("user", "q"), ("assistant", "a")]),
        7: ("prompt_completion", [("user", "[]"), ("assistant", "[]")]),
        8: (None, []),
        9: ("prompt_completion_turns", [("", "stray"), ("user", "q"), ("assistant", "a")]),
    }
