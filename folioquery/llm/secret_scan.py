"""Secret scans with an incremental blob ledger.

Every version of a file is addressed by the SHA-256 of its text, its blob. The ledger, a Parquet table in the shared folder, holds a row for
each (blob, rule version) pair ever scanned, with the spans found. A run first compares hashes with the ledger, then scans the texts of blobs with
pairs that the ledger lacks, each distinct blob once however many paths carry it, appends them, and joins the findings back to all paths. A rule's
version is the hash of its definition, so a new or changed rule is run over all blobs, and an unchanged one only over new blobs.

Rules: three base ones, and key blocks, tokens of known formats, and long strings of high entropy.

Scale: with a new ledger texts are shuffled once, by blob; later only hashes are, and the texts of what is unseen. The join back to paths moves
hashes and spans, no texts, and a blob under a third of all paths is only a skewed join key that Spark can split.

Defined results: a null text is the empty blob; a path (or doc_id) that is null or repeated keeps a row for each input
row; an empty table gives an empty table; spans count code points, end exclusive, ordered by start, then by the rules'
order. Only the named columns are read, so others may clash.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, shared_folder, slices, table


#: Rows of a list of hashes, of some hundred bytes each, up to which it is broadcast.
LISTED = 200_000


@dataclass(frozen=True)
class Rule:
    """A pattern, and the least length of a match (group 0) or of one of its groups; shorter matches are dropped.

    A text without any of needles (in lower case) has no match. With scanner, the name of one of SCANNERS, that finds the spans, of any length and in one pass
    over the text, and the pattern tells it where to look. With entropy, a match of less than so many bits a character is dropped too, and
    so is one that lacks capitals, small letters or digits.
    """

    kind: str
    pattern: str
    least: int
    group: int = 0
    ignore_case: bool = False
    needles: tuple[str, ...] = ()
    entropy: float = 0.0
    scanner: str = ""

    @property
    def version(self) -> str:
        return hashlib.sha256(repr(self).encode()).hexdigest()[:16]

    def spans(self, text: str, lowered: str) -> Iterator[tuple[int, int]]:
        if self.needles and not any(n in lowered for n in self.needles):
            return
        if self.scanner:
            yield from SCANNERS[self.scanner](self.pattern, text)
            return
        flags = re.ASCII | (re.IGNORECASE if self.ignore_case else 0)
        for m in re.compile(self.pattern, flags).finditer(text):
            if m.end(self.group) - m.start(self.group) >= self.least and (not self.entropy or self._random(m[0])):
                yield m.span()

    def _random(self, value: str) -> bool:
        if not (re.search("[A-Z]", value) and re.search("[a-z]", value) and re.search("[0-9]", value)):
            return False
        return -sum(n / len(value) * log2(n / len(value)) for n in Counter(value).values()) >= self.entropy


def _key_blocks(head: str, text: str) -> Iterator[tuple[int, int]]:
    """A head, and all up to the first end mark of the same name if only signs of a key's body lie between."""
    heads = list(re.finditer(head, text))
    if not heads:
        return
    stops = [m.start() for m in re.finditer(r"[^A-Za-z0-9+/=\s:,-]", text, re.ASCII)]
    ends: dict[str, list[int]] = {}
    for m in re.finditer(r"-----END ([A-Z0-9 ]*PRIVATE KEY)(?=-----)", text):
        ends.setdefault(m[1], []).append(m.start())
    done = 0
    for m in heads:
        if m.start() < done:
            continue
        done, closing = m.end(), ends.get(m[1], [])
        i, j = bisect_left(closing, m.end()), bisect_left(stops, m.end())
        if i < len(closing) and (j == len(stops) or closing[i] < stops[j]):
            done = closing[i] + len("-----END -----") + len(m[1])
        yield m.start(), done


def _tokens(runs: str, text: str) -> Iterator[tuple[int, int]]:
    """Three parts with a full stop between, in runs of their letters: from the first eyJ that 8 letters follow, a part that begins so too, and one of 8 letters."""
    for run in re.finditer(runs, text):
        parts, at, i = run[0].split("."), run.start(), 0
        while i + 2 < len(parts):
            begun = parts[i].find("eyJ")
            if begun >= 0 and len(parts[i]) - begun >= 11 and parts[i + 1].startswith("eyJ") and len(parts[i + 1]) >= 11 and len(parts[i + 2]) >= 8:
                size = sum(map(len, parts[i : i + 3])) + 2
                yield at + begun, at + size
                at, i = at + size + 1, i + 3
            else:
                at, i = at + len(parts[i]) + 1, i + 1


SCANNERS: dict[str, Callable[[str, str], Iterator[tuple[int, int]]]] = {"key blocks": _key_blocks, "tokens": _tokens}
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, group=2, ignore_case=True, needles=("password", "passwd", "secret", "token", "apikey", "api_key")),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),  # a maximal run of hex digits either is long enough or holds no match
)
RULES = (
    *BASE,
    Rule("pem", r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----", 1, needles=("-----begin",), scanner="key blocks"),
    Rule("github", r"(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})", 1, needles=("gh", "github_pat_")),
    Rule("slack", r"xox[abeoprs]-[A-Za-z0-9-]{10,}", 1, needles=("xox",)),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}", 1, needles=("aiza",)),
    Rule("stripe", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}", 1, needles=("k_live_", "k_test_")),
    Rule("jwt", r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+)++", 1, needles=("eyj",), scanner="tokens"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@?#]++:[^\s:/@?#]{3,}+@", 1, needles=("://",)),  # a longer scheme is found by its end
    Rule("random", r"[A-Za-z0-9+/_=-]{32,}", 32, entropy=4.3),
)
_FOUND = "array<struct<kind:string,start:int,end:int>>"
LEDGER = f"blob string, rule_version string, spans {_FOUND}"


def scan_blobs(pairs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Ledger rows for pairs(blob, text, rule_versions array): the rules named there are run over the text."""
    known = {r.version: r for r in rules}
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            blobs, versions, found = [], [], []
            for blob, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("blob", "text", "rule_versions")), strict=True):
                lowered = (text or "").lower()
                for v in wanted:
                    blobs.append(blob)
                    versions.append(v)
                    found.append([{"kind": known[v].kind, "start": a, "end": b} for a, b in known[v].spans(text or "", lowered)])
            yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(versions, pa.string()), pa.array(found, kind)], ["blob", "rule_version", "spans"])

    return pairs.select("blob", "text", "rule_versions").mapInArrow(run, LEDGER)


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger in path, or None if nothing has been written there."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition()):
            raise
        return None


def unseen(versions: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, text, rule_versions) for the pairs that the ledger (None: a new one) lacks, each distinct blob once."""
    every = F.array(*[F.lit(r.version) for r in rules])
    texts = lambda rows: rows.groupBy("blob").agg(F.any_value("text").alias("text"))
    if ledger is None:
        return texts(versions).withColumn("rule_versions", every)
    seen = ledger.groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
    lacking = F.array_except(every, F.coalesce("seen", F.array().cast("array<string>")))
    wanted = versions.select("blob").distinct().join(seen, "blob", "left").select("blob", lacking.alias("rule_versions")).where(F.size("rule_versions") > 0)
    few = wanted.limit(LISTED + 1).count() <= LISTED
    return texts(versions.join(F.broadcast(wanted.select("blob")) if few else wanted.select("blob"), "blob", "left_semi")).join(wanted, "blob")


def findings(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """versions with a column spans: all that these rules' versions found in its blob, in order."""
    rank = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    flat = ledger.where(F.col("rule_version").isin([r.version for r in rules]) & (F.size("spans") > 0)).dropDuplicates(["blob", "rule_version"])
    flat = flat.groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    order = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    flat = flat.select("blob", F.transform(order, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))
    out = versions.join(flat, "blob", "left")
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(_FOUND)))


def extend_ledger(versions: DataFrame, path: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger in path, once the pairs of versions(blob, text) that it lacks are scanned and appended."""
    spark = versions.sparkSession
    scan_blobs(unseen(versions, read_ledger(spark, path), rules), rules).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def new_ledger(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"


def scan(docs: DataFrame, key: str = "doc_id", ledger_path: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, blob, spans) for each row of docs(key, text); the ledger in ledger_path, else a new one, is used and extended."""
    versions = docs.select(F.col(key).alias("_key"), F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))
    ledger = extend_ledger(versions.select("blob", "text"), ledger_path or new_ledger(docs.sparkSession), rules)
    return findings(versions.select("_key", "blob"), ledger, rules).select(F.col("_key").alias(key), "blob", "spans")


def redact(text: str, spans: list[dict], mark: str = "[{kind}]") -> str:
    """text with each span replaced by its kind; overlapping spans count from where the one before ends."""
    out, at = [], 0
    for s in spans:
        out.append(text[at : s["start"]])
        if s["end"] > at:
            out.append(mark.replace("{kind}", s["kind"]))
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def without_secrets(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """The rows of docs, all columns, with secrets in text replaced by their kind, and n_chars, if there, counted anew.

    Texts with findings are joined to them by blob; where the list of these is small it is broadcast, and no text is shuffled for it.
    """
    blob, spans = fresh("blob", docs), fresh("spans", docs)
    named = docs.withColumn(blob, F.sha2(F.coalesce("text", F.lit("")), 256))
    ledger = extend_ledger(named.select(F.col(blob).alias("blob"), F.coalesce("text", F.lit("")).alias("text")), ledger_path or new_ledger(docs.sparkSession))
    blobs = ledger.where(F.size("spans") > 0).select("blob").distinct()
    found = findings(blobs, ledger).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    few = blobs.limit(LISTED + 1).count() <= LISTED
    rows = named.join(F.broadcast(found) if few else found, blob, "left").select(*docs.columns, spans)
    counted = "n_chars" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            listed, out = batch.column(spans).to_pylist(), batch.drop_columns([spans])
            if any(listed):
                texts = batch.column("text").to_pylist()
                texts = [redact(t, s) if s and t else t for t, s in zip(texts, listed, strict=True)]
                out = out.set_column(out.schema.get_field_index("text"), "text", pa.array(texts, out.schema.field("text").type))
                if counted:
                    counts = [len(t) if s and t else n for t, s, n in zip(texts, listed, batch.column("n_chars").to_pylist(), strict=True)]
                    out = out.set_column(out.schema.get_field_index("n_chars"), "n_chars", pa.array(counts, out.schema.field("n_chars").type))
            yield out

    return rows.mapInArrow(run, docs.schema)


def op7_secret_scan(spark: SparkSession, sf_dir: str, ledger_path: str | None = None) -> DataFrame:
    """Two runs over a history that grows, with one ledger, new unless given: first the versions up to the middle of the doc_ids, then all. The second scans only texts and
    rules that the first has not, and joins what both found to every document."""
    docs, ledger = table(spark, sf_dir, "documents").select("doc_id", "text"), ledger_path or new_ledger(spark)
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    if low is not None:
        older = docs.where(F.col("doc_id") <= low + (high - low) // 2)
        extend_ledger(older.select(F.coalesce("text", F.lit("")).alias("text")).select("text", F.sha2("text", 256).alias("blob")), ledger)
    found = scan(docs, ledger_path=ledger)
    base = [r.kind for r in BASE]
    joined = lambda kept: F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in base], F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES = {"op7_secret_scan": op7_secret_scan}
ORACLE_SQL: dict[str, str] = {}
