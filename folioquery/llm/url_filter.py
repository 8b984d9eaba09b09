"""URL filters as a sort-merge range join [native].

A rule (host, path) becomes the canonical key `reversed host labels, NUL, path`; all keys that start with it form the
interval from the key to the key's end mark, so rules nest or are disjoint. A url is probed once for each suffix of its
host (its own host and every parent domain). Rules and probes are sorted together by key and swept once: the sweep
carries the last rule opened and the stack of rules that enclose it; the deepest one still open at a probe is the
longest fit on that domain, and the longest over a url's probes wins.

Scale: pages are dealt at random over shards, and the rules go to every shard, so a host with a third of all pages is
spread evenly and no task sorts more than its share. Rules are a small list; their rows are shards x rules. There
is no broadcast, no Python, and the sweep is one window over rows that are already sorted.

Defined results: a null url or one without `://` has an empty host and path and matches only a rule with an empty host;
an empty rule table gives the default verdict to all; repeated pages give one row each; of equal rules the one
whose action comes first in the alphabet is taken; a rule with a null host is ignored and a null path means ''.
Other columns of the input are ignored, so clashing names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

#: Rows that a shard sorts, roughly.
SHARD_ROWS = 200_000
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _key(reversed_host: Column, path: Column) -> Column:
    return F.encode(F.concat(reversed_host, F.lit("\0"), path), "UTF-8")


def stacked(rules: DataFrame) -> DataFrame:
    """Rules as (key, stack): stack has the rule itself and those that enclose it, the deepest first.

    The enclosing rules of a key are those whose key is a prefix of it: an equi-join on the key's own prefixes.
    """
    rules = rules.where(F.col("host").isNotNull()).select("action", F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    rules = rules.groupBy("host", "path").agg(F.min("action").alias("action"))
    one = rules.select(
        _key(_reversed(F.col("host")), F.col("path")).alias("key"),
        F.struct(F.length(F.concat("host", "path")).alias("size"), F.concat("host", "path").alias("rule"), F.col("action").alias("action"), _key(_reversed(F.col("host")), F.col("path")).alias("open")).alias("it"),
    )
    prefixes = one.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("prefix"))
    return prefixes.join(one.select(F.col("key").alias("prefix"), "it"), "prefix").groupBy("key").agg(F.sort_array(F.collect_list("it"), asc=False).alias("stack"))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", shards: int | None = None) -> DataFrame:
    """pages(page_id, url, ...) with rules(action, host, path): page_id, host, path, rule, verdict."""
    spark = pages.sparkSession
    if shards is None:
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-4 * pages.count() // SHARD_ROWS))
    judged = pages.select("page_id", F.monotonically_increasing_id().alias("row"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    judged = judged.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.array_join(F.slice(F.reverse(labels), F.lit(1), n), "."))
    probes = judged.select("*", F.explode(suffixes).alias("domain")).select("shard", _key(F.col("domain"), F.col("path")).alias("key"), F.lit(1).alias("kind"), "row", "page_id", "host", "path", F.lit(None).cast(_stack_type()).alias("stack"))
    opened = stacked(rules).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "key", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("row"), F.lit(None).cast(pages.schema["page_id"].dataType).alias("page_id"), F.lit("").alias("host"), F.lit("").alias("path"), F.col("stack").cast(_stack_type()))
    sweep = Window.partitionBy("shard").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = probes.unionByName(opened).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    open_now = F.filter("stack", lambda r: F.startswith(F.col("key"), r["open"]))
    best = F.get(open_now, F.lit(0))
    won = swept.select("shard", "row", "page_id", "host", "path", best.alias("best"))
    won = won.groupBy("shard", "row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("best").alias("best"))
    return won.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def _stack_type() -> str:
    return "array<struct<size:int,rule:string,action:string,open:binary>>"


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "action string, host string, path string")
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)


QUERIES = {"op10_url_filter": op10_url_filter}
_FIT = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
_CASES = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
ORACLE_SQL = {
    "op10_url_filter": f"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM cut),
parts AS (SELECT page_id, translate(raw, '{_UPPER}', '{_LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM split)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_FIT.format(h=h, p=p)} THEN '{h}{p}'" for _, h, p in _CASES)} END AS rule,
  CASE {" ".join(f"WHEN {_FIT.format(h=h, p=p)} THEN '{a}'" for a, h, p in _CASES)} ELSE 'allow' END AS verdict
FROM parts"""
}
