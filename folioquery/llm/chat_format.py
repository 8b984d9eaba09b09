"""Chat formatting by schema fingerprints [native].

A record (VARIANT, or JSON text) is described by its nested field paths at any depth, for example `messages[].role`. Those of its paths that
a mapping names are sorted and hashed; a record whose fingerprint is the mapping's own has all its fields, and the first such declarative
mapping, in the order of MAPPINGS, says where turns, roles and texts lie. All layouts end as `turns array<struct<role,text>>`, then as one string:

    <|im_start|>ROLE\\nTEXT<|im_end|>\\n   (once for each turn)

Control strings inside a role or text get one more backslash after their first character, which `unescaped` takes
away again; `</s>` becomes `<\\/s>` and `<\\/s>` becomes `<\\\\/s>`, so no text can end its turn and every text comes back.
A role's own backslashes and line feeds are written `\\\\` and `\\n`. The loss mask is a run-length list over the code points of the
string; the runs of assistant texts count.

Scale: one hash aggregation by conversation for row-shaped input, nothing to shuffle for nested records. A conversation
is one string by definition, so its rows meet in one task; no other rows do.

Defined results: null roles and texts are empty; rows of a conversation are ordered by turn (null first), then role, then
text, and repeated rows stay; a record that is null, is no JSON, or lacks some path of every mapping gets layout null and no turns; a text that is
itself a list or object is its JSON, but of a list with parts that are texts or have one it is those texts, one to a line, turn by turn, so the turns of a record may
differ; an item of a list of turns that is a text and no object is a turn with an empty role; an empty table gives an empty table. Fields and columns that no mapping knows, nested ones too, are ignored.
"""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_ANGLE = r"(<)(\\*)(/?s>|<SYS>>|</SYS>>|\|(?:im_start|im_end|endoftext|system|user|assistant|end)\|>)"
_SQUARE = r"(\[)(\\*)(/?INST\])"

ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: layout: the lists of turns and their fields, or the fields of each turn of a flat record; roles: other names for canonical roles; parts: the field of a part of a text
#: that is a list; typed: texts are texts in every turn, and can be read at once.
MAPPINGS: dict[str, dict] = {
    "rows": {"lists": ["turns"], "fields": ["turn", "role", "text"], "role": "role", "text": "text", "typed": True},
    "messages_parts": {"lists": ["messages"], "fields": ["role"], "role": "role", "text": "content", "parts": "text"},
    "messages": {"lists": ["messages"], "fields": ["role", "content"], "role": "role", "text": "content"},
    "prompt_completion_turns": {"lists": ["prompt", "completion"], "fields": ["role", "content"], "role": "role", "text": "content"},
    "from_value": {"lists": ["conversations"], "fields": ["from", "value"], "role": "from", "text": "value", "roles": ROLES},
    "instruction_input": {"flat": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "instruction": {"flat": [("user", ["instruction"]), ("assistant", ["output"])]},
    "system_prompt": {"flat": [("system", ["system"]), ("user", ["prompt"]), ("assistant", ["response"])]},
    "prompt_response": {"flat": [("user", ["prompt"]), ("assistant", ["response"])]},
    "prompt_completion": {"flat": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "question_answer": {"flat": [("user", ["question"]), ("assistant", ["answer"])]},
}


def paths_of(mapping: dict) -> list[str]:
    if "lists" in mapping:
        fields = [*mapping["fields"], *([f"{mapping['text']}[].{mapping['parts']}"] if "parts" in mapping else [])]
        return sorted(f"{name}[].{f}" for name in mapping["lists"] for f in fields)
    return sorted(f for _, fields in mapping["flat"] for f in fields)


def field_paths(record: Column) -> Column:
    """The nested field paths of a VARIANT, in order."""
    return paths_in(F.schema_of_variant(record))


def paths_in(schema: Column) -> Column:
    """The nested field paths of the schema of a VARIANT: it is read token by token, with a stack of the prefixes that are open."""
    tokens = F.regexp_extract_all(schema, F.lit(r"(?:`(?:[^`]|``)*`|[^<>,:` ]+): |OBJECT<|ARRAY<|>"), F.lit(0))
    kind = "struct<open:array<string>,at:string,paths:array<string>>"

    def state(opened: Column, at: Column, paths: Column) -> Column:
        return F.struct(opened.alias("open"), at.alias("at"), paths.alias("paths")).cast(kind)

    def step(s: Column, token: Column) -> Column:
        name = F.regexp_replace(F.substring(token, F.lit(1), F.length(token) - 2), "^`|`$", "")
        here = F.concat(F.coalesce(F.try_element_at(s["open"], F.lit(-1)), F.lit("")), F.replace(name, F.lit("``"), F.lit("`")))
        prefix = F.when(s["at"] == "", "").otherwise(F.concat(s["at"], F.lit(".")))
        last = F.coalesce(F.try_element_at(s["open"], F.lit(-1)), F.lit(""))
        return (
            F.when(token == ">", state(F.slice(s["open"], F.lit(1), F.size(s["open"]) - 1), s["at"], s["paths"]))
            .when(token == "OBJECT<", state(F.concat(s["open"], F.array(prefix)), s["at"], s["paths"]))
            .when(token == "ARRAY<", state(F.concat(s["open"], F.array(last)), F.concat(s["at"], F.lit("[]")), s["paths"]))
            .otherwise(state(s["open"], here, F.concat(s["paths"], F.array(here))))
        )

    return F.array_sort(F.array_distinct(F.aggregate(tokens, state(F.array(), F.lit(""), F.array()), step, lambda s: s["paths"])))


def fingerprint(paths: Column, mapping: dict) -> Column:
    """The hash of those of a record's paths that the mapping names."""
    return F.xxhash64(F.array_join(F.filter(paths, lambda p: p.isin(paths_of(mapping))), ","))


#: Lists whose items may be of several kinds, so that a record's schema does not say what they hold.
_LISTS = sorted({name for m in MAPPINGS.values() if not m.get("typed") for name in m.get("lists", [])})


def all_paths(record: Column, schema: Column) -> Column:
    """field_paths of a record of this schema, and those below the lists of turns whose items are of several kinds, read item by item."""

    def below(name: str) -> Column:
        items = F.try_variant_get(record, f"$.{name}", "array<variant>")
        mixed = schema.rlike(rf"^OBJECT<(?:.*, )?`?{name}`?: ARRAY<VARIANT>")
        return F.when(mixed, F.flatten(F.transform(items, lambda e: F.transform(paths_in(F.schema_of_variant(e)), lambda p: F.concat(F.lit(f"{name}[]."), p)))))

    more = F.when(F.contains(schema, F.lit("ARRAY<VARIANT>")), F.flatten(F.array_compact(F.array(*map(below, _LISTS)))))
    return F.array_sort(F.array_distinct(F.concat(paths_in(schema), F.coalesce(more, F.array().cast("array<string>")))))


def _text_of(value: Column) -> Column:
    """The text of a VARIANT: of a list, those of its items that are texts or have one, if any."""
    kind = lambda v: F.schema_of_variant(v)
    part = lambda p: F.coalesce(F.try_variant_get(p, "$.text", "string"), F.when(kind(p) == "STRING", F.try_variant_get(p, "$", "string")))
    texts = F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), part), lambda t: t.isNotNull())
    return F.when(F.startswith(kind(value), F.lit("ARRAY")) & (F.size(texts) > 0), F.array_join(texts, "\n")).otherwise(F.try_variant_get(value, "$", "string"))


def _turns(record: Column, layout: Column) -> Column:
    """The turns of a VARIANT by its layout; lists of turns of every layout share one expression, which the layout tells what fields to read."""
    typed = {n: m for n, m in MAPPINGS.items() if m.get("typed")}
    lists = {n: m for n, m in MAPPINGS.items() if "lists" in m and n not in typed}
    chosen = lambda what: reduce(lambda c, x: c.when(layout == x[0], what(x[1])), lists.items(), F.when(F.lit(False), None))
    none = F.array().cast("array<variant>")
    items = chosen(lambda m: F.concat(*[F.coalesce(F.try_variant_get(record, f"$.{name}", "array<variant>"), none) for name in m["lists"]]))

    def field(e: Column, which: str, kind: str) -> Column:
        names = {m[which] for m in lists.values()}
        return F.coalesce(*[F.when(layout.isin([n for n, m in lists.items() if m[which] == name]), F.try_variant_get(e, f"$.{name}", kind)) for name in sorted(names)])

    def turn(e: Column) -> Column:
        text = F.when(F.schema_of_variant(e) == "STRING", F.try_variant_get(e, "$", "string")).otherwise(_text_of(field(e, "text", "variant")))
        role = F.coalesce(field(e, "role", "string"), F.lit(""))
        return F.struct(reduce(lambda c, x: c.when(renamed & (role == x[0]), x[1]), ROLES.items(), F.when(F.lit(False), "")).otherwise(role).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    renamed = layout.isin([n for n, m in lists.items() if "roles" in m])
    out = F.when(layout.isin(list(lists)), F.transform(items, turn))
    for name, m in typed.items():
        kind = ", ".join(f"`{f}`: " + ("bigint" if f == "turn" else "string") for f in m["fields"])
        rows = F.sort_array(F.try_variant_get(record, f"$.{m['lists'][0]}", f"array<struct<{kind}>>"))
        out = out.when(layout == name, F.transform(rows, partial(_named_turn, m)))
    for name, m in MAPPINGS.items():
        if "flat" in m:
            out = out.when(layout == name, F.array(*[_turn(F.lit(role), _flat_text(record, fields)) for role, fields in m["flat"]]))
    return out


def _named_turn(mapping: dict, x: Column) -> Column:
    return _turn(x[mapping["role"]], x[mapping["text"]])


def _flat_text(record: Column, fields: list[str]) -> Column:
    texts = [F.coalesce(F.try_variant_get(record, f"$.{f}", "string"), F.lit("")) for f in fields]
    return texts[0] if len(texts) == 1 else F.when(texts[1] == "", texts[0]).otherwise(F.concat_ws("\n", *texts))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def layout_of(paths: Column) -> Column:
    """The first mapping that has the fingerprint of a record with these field paths."""
    is_it = lambda m: fingerprint(paths, m) == F.xxhash64(F.lit(",".join(paths_of(m))))
    return reduce(lambda c, x: c.when(is_it(x[1]), x[0]), MAPPINGS.items(), F.when(F.lit(False), F.lit("")))


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _ANGLE, r"$1\\$2$3"), _SQUARE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, _ANGLE.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3"), _SQUARE.replace(r"(\\*)", r"\\(\\*)"), "$1$2$3")


def _escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescaped_role(role: Column) -> Column:
    parts = F.transform(F.split(unescaped(role), r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return F.array_join(parts, "\\")


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), _escaped_role(t["role"]), F.lit("\n"), escaped(t["text"]), F.lit(CLOSE + "\n"))), "")


def loss_runs(turns: Column) -> Column:
    """Runs over the code points of the formatted string; only the texts of assistant turns count."""

    def runs(t: Column) -> Column:
        head = F.length(_escaped_role(t["role"])) + len(OPEN) + 1
        body = F.length(escaped(t["text"]))
        run = lambda n, counts: F.struct(n.cast("bigint").alias("length"), counts.alias("counts"))
        return F.array(run(head, F.lit(False)), run(body, t["role"] == "assistant"), run(F.lit(len(CLOSE) + 1), F.lit(False)))

    return F.flatten(F.transform(turns, runs))


def read_back(formatted: Column) -> Column:
    """turns array<struct<role,text>> from the formatted string alone."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n"), lambda p: p != "")

    def turn(piece: Column) -> Column:
        body = F.substr(piece, F.lit(len(OPEN) + 1))
        role = F.substring_index(body, "\n", 1)
        return F.struct(_unescaped_role(role).alias("role"), unescaped(F.substr(body, F.length(role) + 2)).alias("text"))

    return F.transform(pieces, turn)


def under_mask(text: Column, runs: Column, block: int = 64) -> Column:
    """The pieces of text under the runs that count, in order; runs are cut out block by block, so that no piece is sought from the text's start."""
    numbers = F.when(F.size(runs) > 0, F.sequence(F.lit(0), F.floor((F.size(runs) - 1) / block).cast("int"))).otherwise(F.array().cast("array<int>"))
    parts = F.transform(numbers, lambda b: F.slice(runs, b * block + 1, F.lit(block)))
    total = lambda part: F.aggregate(part, F.lit(0).cast("bigint"), lambda n, r: n + r["length"])
    cell = "array<struct<chunk:string,runs:array<struct<length:bigint,counts:boolean>>>>"

    def cut(s: Column, part: Column) -> Column:
        n = total(part)
        chunk = F.struct(F.substring(text, (s["at"] + 1).cast("int"), n.cast("int")).alias("chunk"), part.alias("runs"))
        return F.struct((s["at"] + n).alias("at"), F.concat(s["out"], F.array(chunk).cast(cell)).alias("out"))

    chunks = F.aggregate(parts, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(cell).alias("out")), cut, lambda s: s["out"])

    def pieces(x: Column) -> Column:
        none = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

        def step(s: Column, r: Column) -> Column:
            piece = F.array(F.substring(x["chunk"], (s["at"] + 1).cast("int"), r["length"].cast("int")))
            return F.struct((s["at"] + r["length"]).alias("at"), F.when(r["counts"], F.concat(s["out"], piece)).otherwise(s["out"]).alias("out"))

        return F.aggregate(x["runs"], none, step, lambda s: s["out"])

    return F.flatten(F.transform(chunks, pieces))


def format_records(records: DataFrame, id_column: str, record_column: str) -> DataFrame:
    """id, layout, turns, formatted and loss_runs of each record (VARIANT, or JSON text)."""
    record = F.col(record_column)
    if records.schema[record_column].dataType.typeName() == "string":
        record = F.try_parse_json(record)
    out = records.select(F.col(id_column).alias("_id"), record.alias("_record"))
    out = out.select("_id", "_record", F.schema_of_variant("_record").alias("_schema"))
    out = out.select("_id", "_record", F.coalesce(all_paths(F.col("_record"), F.col("_schema")), F.array().cast("array<string>")).alias("_paths"))
    out = out.select("_id", "_record", layout_of(F.col("_paths")).alias("layout"))
    out = out.select("_id", "layout", F.coalesce(_turns(F.col("_record"), F.col("layout")), F.array().cast("array<struct<role:string,text:string>>")).alias("turns"))
    return out.select(F.col("_id").alias(id_column), "layout", "turns", render(F.col("turns")).alias("formatted"), loss_runs(F.col("turns")).alias("loss_runs"))


def records_of_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, record) from conversations(conv_id, turn, role, text)."""
    turn = F.struct(F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return rows.groupBy("conv_id").agg(F.to_variant_object(F.struct(F.collect_list(turn).alias("turns"))).alias("record"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = format_records(records_of_rows(rows), "conv_id", "record")
    out = out.select("conv_id", "formatted", read_back(F.col("formatted")).alias("back"), under_mask(F.col("formatted"), F.col("loss_runs")).alias("learned"))
    loss = F.array_join(F.transform("learned", unescaped), "")
    said = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("back").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


QUERIES = {"op3_chat_format": op3_chat_format}


def _sql_escaped(x: str) -> str:
    for rx in (_ANGLE, _SQUARE):
        x = f"regexp_replace({x}, '{rx}', '\\1\\\\\\2\\3', 'g')"
    return x


ORACLE_SQL = {
    "op3_chat_format": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length({_sql_escaped("text")}) + length(role) + {len(OPEN) + len(CLOSE) + 2}) AS chars
  FROM rows GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars AS BIGINT) AS formatted_chars
FROM said"""
}
