"""Discovery: links of pages, host policy, listings, and the crawl of what they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..catalog import Catalog
from ..functions import vocabulary as V
from ..functions import web as W
from ..sources.tables import load

C = Catalog()
SUFFIXES, BLOCKED = ("example.com", "example.org"), ("news.example.com",)
_ANCHOR = r"(?is)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a>"


def text_of(html: Column) -> Column:
    """Text of a fragment: tags as blanks, the common entities resolved, white space collapsed."""
    out = F.regexp_replace(html, "<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def anchors(pages: DataFrame) -> DataFrame:
    """(page_id, page_url, turn, href, link_text) for each link in order."""
    found = pages.select("page_id", F.col("url").alias("page_url"), F.posexplode(F.regexp_extract_all("html", F.lit(_ANCHOR), F.lit(0))).alias("turn", "a"))
    return found.select("page_id", "page_url", "turn", F.trim(F.regexp_extract("a", _ANCHOR, 1)).alias("href"), text_of(F.regexp_extract("a", _ANCHOR, 2)).alias("link_text"))


def links(pages: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """Links of each page, resolved; first is false where the page has the address already, kind is null for rejected hosts."""
    rows = anchors(pages).where("href <> ''").where(~F.lower("href").rlike("^(javascript|mailto|tel):"))
    rows = rows.withColumn("url", W.without_fragment(W.resolved(F.col("page_url"), F.col("href"))))
    rows = rows.withColumn("first", F.row_number().over(Window.partitionBy("page_id", "url").orderBy("turn")) == 1)
    rows = rows.withColumn("approved", W.approved(F.col("url"), suffixes, blocked))
    same = W.host(F.col("url")).eqNullSafe(W.host(F.col("page_url")))
    follow = F.col("url").rlike(V.PAGINATION) | (F.col("link_text").rlike(V.NEXT_TEXT) & same)
    kind = F.when(F.col("approved"), W.page_kind(F.col("url"), F.col("link_text")))
    return rows.withColumn("kind", kind).withColumn("follow", F.col("first") & F.col("approved") & (kind != "document") & follow)


def counters(rows: DataFrame) -> DataFrame:
    """What a page leads to: documents, listings and other pages, and the links rejected or seen before."""
    n = lambda c: F.count_if(F.col("first") & c)
    kind = lambda k: n(F.col("approved") & (F.col("kind") == k))
    return rows.groupBy("page_id").agg(
        kind("document").alias("n_documents"), kind("department_page").alias("n_department"), kind("listing").alias("n_listing"), kind("document_page").alias("n_document_pages"),
        n(~F.col("approved")).alias("n_rejected"), F.count_if(~F.col("first")).alias("n_skipped"), F.count_if("follow").alias("n_follow"),
    )


_HREFS = """hrefs AS (SELECT page_id, url AS page_url, unnest(regexp_extract_all(html, '(?is)<a\\s[^>]*?href\\s*=\\s*["'']([^"'']*)["'']', 1)) AS href FROM pages),
found AS (SELECT page_id, page_url, regexp_extract(page_url, '^[a-z]+://[^/?#]*') || regexp_replace(href, '#.*$', '') AS url FROM hrefs WHERE starts_with(href, '/')),
judged AS (SELECT page_id, page_url, url, count(*) AS times, (regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) SIMILAR TO '(.*\\.)?(example\\.com|example\\.org)') AND regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1) <> 'news.example.com' AS approved FROM found GROUP BY page_id, page_url, url)"""


@C.query(f"WITH {_HREFS} SELECT page_id, url, CAST(times AS BIGINT) AS times, approved FROM judged")
def link_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = links(load(spark, sf_dir, "pages"))
    return rows.groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("times"), F.first("approved").alias("approved"))


@C.query(
    f"WITH {_HREFS} SELECT page_id, count(*) FILTER (NOT approved) AS n_rejected, CAST(sum(times - 1) AS BIGINT) AS n_skipped, count(*) FILTER (approved AND regexp_matches(lower(url), '\\.(html|htm|php)$|/document/|/documents') AND NOT contains(lower(url), 'department') AND NOT contains(lower(url), 'gazette')) AS n_document_pages FROM judged GROUP BY page_id"
)
def crawl_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters(links(load(spark, sf_dir, "pages"))).select("page_id", "n_rejected", "n_skipped", "n_document_pages")


@C.query(
    "WITH h AS (SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host FROM pages) SELECT page_id, host, (host IN ('example.com', 'example.org') OR ends_with(host, '.example.com') OR ends_with(host, '.example.org')) AND host <> 'news.example.com' AS approved FROM h"
)
def host_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", W.host(F.col("url")).alias("host"), W.approved(F.col("url"), SUFFIXES, BLOCKED).alias("approved"))


@C.query(
    "WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id + 1000000, regexp_replace(url, '#.*$', '') || '#again' FROM pages) SELECT trim(regexp_replace(url, '#.*$', '')) AS url, min(page_id) AS first_id, max(page_id) AS last_id, count(*) AS times FROM u GROUP BY 1"
)
def url_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last sight of each address without its fragment."""
    pages = load(spark, sf_dir, "pages").select("page_id", "url")
    again = pages.select((F.col("page_id") + 1000000).alias("page_id"), F.concat(W.without_fragment(F.col("url")), F.lit("#again")).alias("url"))
    rows = pages.unionByName(again).groupBy(W.without_fragment(F.col("url")).alias("url"))
    return rows.agg(F.min("page_id").alias("first_id"), F.max("page_id").alias("last_id"), F.count(F.lit(1)).alias("times"))


@C.query(
    """WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS plain FROM pages), b AS (SELECT page_id, regexp_replace(regexp_replace(regexp_extract(plain, '^[a-z]+://[^/]*(?:/.*)?/([^/]+)/?$', 1), '[^A-Za-z0-9._-]+', '-', 'g'), '^-+|-+$', '', 'g') AS base FROM p)
SELECT page_id, CASE WHEN base = '' THEN 'document.pdf' WHEN ends_with(lower(base), '.pdf') THEN base ELSE base || '.pdf' END AS file_name FROM b"""
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", W.file_name(F.col("url"), F.lit("")).alias("file_name"))


@C.query("SELECT page_id, regexp_matches(url, '(?i)[?&](page|pageno|start|offset)=[0-9]+') AS paged FROM pages")
def pagination_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.col("url").rlike(V.PAGINATION).alias("paged"))


def header_field(cell: Column) -> Column:
    """The field that a header cell names, by the first list of needles that fits."""
    low, out = F.lower(F.trim(cell)), F.when(F.lit(False), "")
    for field, needles in V.HEADER_HINTS.items():
        fits = F.lit(False)
        for n in needles:
            fits = fits | F.contains(low, F.lit(n))
        out = out.when(fits, field)
    return out


def listing_rows(pages: DataFrame) -> DataFrame:
    """(page_id, table, row, href, link_text, hints): the links of table rows, each with what the header says of its row's cells."""
    tables = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<table\b.*?</table>"), F.lit(0))).alias("table", "t"))
    rows = tables.select("page_id", "table", F.regexp_extract_all("t", F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0)).alias("trs"))
    cells = lambda tr: F.regexp_extract_all(tr, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1))
    rows = rows.select("page_id", "table", F.transform(cells(F.get("trs", F.lit(0))), lambda c: header_field(text_of(c))).alias("fields"), F.posexplode("trs").alias("row", "tr"))
    rows = rows.withColumn("cells", cells(F.col("tr")))
    named = F.transform("cells", lambda c, i: F.named_struct(F.lit("field"), F.get("fields", i), F.lit("value"), text_of(c)))
    hints = F.filter(named, lambda z: z["field"].isNotNull() & (z["value"] != ""))
    rows = rows.select("page_id", "table", "row", hints.alias("hints"), F.explode(F.regexp_extract_all("tr", F.lit(_ANCHOR), F.lit(0))).alias("a"))
    return rows.select("page_id", "table", "row", F.trim(F.regexp_extract("a", _ANCHOR, 1)).alias("href"), text_of(F.regexp_extract("a", _ANCHOR, 2)).alias("link_text"), "hints")


@C.query(
    """SELECT o_orderkey // 10 AS page_id, CAST(row_number() OVER (PARTITION BY o_orderkey // 10 ORDER BY o_orderkey) AS BIGINT) AS row, '/go/' || o_orderkey || '.pdf' AS href, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS go_date, 'G.O. No.' || o_orderkey AS go_number, o_orderpriority AS subject FROM orders"""
)
def listing_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages generated from orders, with columns in another order than usual, read back by their header."""
    o = load(spark, sf_dir, "orders")
    row = F.concat(F.lit("<tr><td>"), F.to_date("o_orderdate").cast("string"), F.lit('</td><td><a class="x" href="/go/'), F.col("o_orderkey").cast("string"), F.lit('.pdf">G.O. No.'), F.col("o_orderkey").cast("string"), F.lit("</a></td>\n<td><b>"), F.col("o_orderpriority"), F.lit("</b></td></tr>"))
    trs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("tr")))), lambda x: x["tr"]), "")
    html = F.concat(F.lit("<html><table border=1><tr><th>Date</th><th>G.O. Number</th><th>Subject</th></tr>"), trs, F.lit("</table></html>"))
    pages = o.groupBy(F.floor(F.col("o_orderkey") / 10).alias("page_id")).agg(html.alias("html"))
    rows = listing_rows(pages)
    hint = lambda f: F.get(F.filter("hints", lambda z: z["field"] == f), F.lit(0))["value"].alias(f)
    return rows.select("page_id", F.col("row").cast("bigint").alias("row"), "href", hint("go_date"), hint("go_number"), hint("subject"))


def crawl(edges: DataFrame, start: DataFrame, max_hops: int) -> DataFrame:
    """(node, hop): nodes reached from start(node) along edges(src, dst), each at its first hop; a hop is a join of the frontier alone."""
    seen = start.select("node", F.lit(0).alias("hop")).distinct()
    frontier = seen
    for hop in range(1, max_hops + 1):
        nxt = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct()
        frontier = nxt.join(seen, "node", "left_anti").select("node", F.lit(hop).alias("hop"))
        seen = seen.unionByName(frontier)
    return seen


@C.query(
    """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem), walk(node, hop) AS (SELECT 1::BIGINT, 0 UNION SELECT e.dst, w.hop + 1 FROM walk w JOIN e ON e.src = w.node WHERE w.hop < 3) SELECT node, min(hop) AS hop FROM walk GROUP BY node"""
)
def crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl of three hops from one page; addresses seen before are not visited again."""
    edges = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).distinct()
    return crawl(edges, spark.range(1, 2).select(F.col("id").alias("node")), 3)


QUERIES, ORACLE_SQL = C.queries, C.oracle_sql
