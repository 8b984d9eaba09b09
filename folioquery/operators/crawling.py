"""The crawl orchestrator: many sources at once, request by request, and the harvest of tables in HTML."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window

from ..catalog import Catalog
from ..functions import vocabulary as V
from ..functions import web as W
from ..sources.tables import load
from ..streaming.streams import shared_folder
from .web import BLOCKED, SUFFIXES, anchors

C = Catalog()
MAX_PAGES = 5


def crawl_sources(sources: DataFrame, pages: DataFrame, follow: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """(source, turn, url, hop, status, error): every request that a crawl makes, for each of sources(source, url).

    pages(url, status, error) answers a request, error being a message where there is no answer, and follow(src, turn, dst) lists the addresses that a
    page leads to (ties by address). A source asks in the order in which addresses were found, no address twice, for at most max_pages pages; a page of another status than 200
    leads nowhere, and the first error ends its source. A hop is one join of all sources' frontiers with the pages and links they need, written
    to the shared folder; a frontier keeps the max_pages first addresses of a source, so it stays small whatever a page leads to.
    """
    spark = sources.sparkSession
    folder = shared_folder(spark)
    order = Window.partitionBy("source").orderBy("parent", "place", "url")
    frontier = sources.select("source", "url", F.lit(0).cast("long").alias("parent"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("asked"))
    for hop in range(max_pages):
        turn = F.row_number().over(order)
        asked = frontier.withColumn("rank", turn).where(F.col("rank") <= max_pages).withColumn("turn", F.col("asked") + F.col("rank")).where(F.col("turn") <= max_pages)
        met = asked.join(pages, "url", "left").select("source", "turn", "url", F.lit(hop).alias("hop"), "status", F.when(F.col("status").isNull(), F.coalesce("error", F.lit("no such host"))).otherwise(F.col("error")).alias("error"))
        failed = F.min(F.when(F.col("error").isNotNull(), F.col("turn"))).over(Window.partitionBy("source"))
        met.withColumn("ends", failed).where("ends IS NULL OR turn <= ends").write.parquet(f"{folder}/requests/hop={hop}")
        done = spark.read.parquet(f"{folder}/requests")
        now = done.where(F.col("hop") == hop)
        open_to = now.where("ends IS NULL AND status = 200").select("source", F.col("turn").alias("parent"), F.col("url").alias("src"))
        if open_to.isEmpty():
            break
        found = open_to.join(follow.select("src", F.col("turn").alias("place"), F.col("dst").alias("url")), "src").drop("src")
        first = found.groupBy("source", "url").agg(F.min(F.struct("parent", "place")).alias("at")).select("source", "url", "at.*")
        counts = done.groupBy("source").agg(F.max("turn").cast("long").alias("asked"))
        frontier = first.join(done.select("source", "url"), ["source", "url"], "left_anti").join(counts, "source")
    return spark.read.parquet(f"{folder}/requests").select("source", F.col("turn").cast("long").alias("turn"), "url", F.col("hop").cast("long").alias("hop"), "status", "error")


def crawl_runs_of(sources: DataFrame, requests: DataFrame, documents: DataFrame) -> DataFrame:
    """A run's counters for each source: pages fetched, pages of another status, documents(url, document) seen, new and seen before, and how it ended."""
    answered = requests.where("error IS NULL")
    seen = answered.where("status = 200").join(documents, "url").groupBy("source", "document").agg(F.count(F.lit(1)).alias("times"))
    links = seen.groupBy("source").agg(F.sum("times").alias("links_seen"), F.count(F.lit(1)).alias("new_documents"))
    runs = requests.groupBy("source").agg(F.count_if(F.col("error").isNull()).alias("pages_fetched"), F.count_if(F.col("error").isNull() & (F.col("status") != 200)).alias("page_errors"), F.max("error").alias("error"))
    out = sources.select("source").join(runs, "source", "left").join(links, "source", "left").fillna(0, ["pages_fetched", "page_errors", "links_seen", "new_documents"])
    return out.select("source", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "pages_fetched", "page_errors", "links_seen", "new_documents", (F.col("links_seen") - F.col("new_documents")).alias("duplicate_documents"), "error")


def _site(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Suppliers as sources, parts as pages; a page leads to the part of the next line of each order that has it, and holds those orders as documents."""
    sources = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source"), F.col("s_suppkey").alias("url"))
    error = F.when(F.col("p_size") > 45, "connection reset")
    pages = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("url"), F.when(error.isNull(), F.when(F.col("p_size") < 6, 404).otherwise(200)).alias("status"), error.alias("error"))
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    follow = lines.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_partkey").alias("src"), (F.col("l_orderkey").cast("long") * 10 + F.col("l_linenumber")).alias("turn"), "dst")
    return sources, pages, follow, lines.select(F.col("l_partkey").alias("url"), F.col("l_orderkey").alias("document")).distinct()


_WALK = f"""RECURSIVE page AS (SELECT p_partkey AS url, CASE WHEN p_size > 45 THEN NULL WHEN p_size < 6 THEN 404 ELSE 200 END AS status, CASE WHEN p_size > 45 THEN 'connection reset' END AS error FROM part),
follow AS (SELECT a.l_partkey AS src, list(b.l_partkey ORDER BY a.l_orderkey, a.l_linenumber, b.l_partkey) AS dst FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY a.l_partkey),
walk AS (SELECT s_suppkey AS source, 0::BIGINT AS turn, NULL::BIGINT AS url, NULL::INTEGER AS status, NULL::VARCHAR AS error, [s_suppkey::BIGINT] AS queue, []::BIGINT[] AS visited FROM supplier
UNION ALL SELECT w.source, w.turn + 1, w.q[1], p.status, CASE WHEN p.url IS NULL THEN 'no such host' ELSE p.error END, CASE WHEN p.status = 200 THEN list_concat(w.q[2:], coalesce(f.dst, [])) ELSE w.q[2:] END, list_append(w.visited, w.q[1])
FROM (SELECT source, turn, visited, list_filter(queue, lambda x: NOT list_contains(visited, x)) AS q FROM walk WHERE error IS NULL AND turn < {MAX_PAGES}) w LEFT JOIN page p ON p.url = w.q[1] LEFT JOIN follow f ON f.src = w.q[1] WHERE len(w.q) > 0)"""


@C.query(f"WITH {_WALK} SELECT source, turn, url, status, error FROM walk WHERE turn > 0")
def crawl_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row of evidence for each request, in the order in which each source makes them."""
    sources, pages, follow, _ = _site(spark, sf_dir)
    return crawl_sources(sources, pages, follow).drop("hop")


@C.query(
    f"""WITH {_WALK}, r AS (SELECT * FROM walk WHERE turn > 0), d AS (SELECT r.source, l.l_orderkey AS document, count(DISTINCT r.turn) AS times FROM r JOIN lineitem l ON l.l_partkey = r.url WHERE r.status = 200 GROUP BY 1, 2),
n AS (SELECT source, sum(times) AS links_seen, count(*) AS new_documents FROM d GROUP BY source)
SELECT r.source, CASE WHEN max(error) IS NULL THEN 'ok' ELSE 'error' END AS status, count(*) FILTER (error IS NULL) AS pages_fetched, count(*) FILTER (status <> 200 AND error IS NULL) AS page_errors,
CAST(coalesce(max(links_seen), 0) AS BIGINT) AS links_seen, coalesce(max(new_documents), 0) AS new_documents, CAST(coalesce(max(links_seen) - max(new_documents), 0) AS BIGINT) AS duplicate_documents, max(error) AS error
FROM r LEFT JOIN n USING (source) GROUP BY r.source"""
)
def crawl_run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run of each source: how it ended and what it found."""
    sources, pages, follow, documents = _site(spark, sf_dir)
    return crawl_runs_of(sources, crawl_sources(sources, pages, follow), documents)


class _Tables(HTMLParser):
    """The links of table rows. A row belongs to every table that is open around it, and a cell to every open row, so nested tables count as part of the outer
    ones and stand for themselves; a cell or row that is not closed ends where its table's next one begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list] = []  # of each table its rows, each a list of cells (texts, anchors)
        self.open: list[tuple[str, list]] = []
        self.anchor: tuple[str, list] | None = None

    def _close(self, *names: str) -> None:
        """Close up to the innermost open element of these names, if its table is the innermost one."""
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in names:
                del self.open[i:]
                return
            if self.open[i][0] == "table":
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.tables.append([])
            self.open.append(("table", self.tables[-1]))
        elif tag == "tr":
            self._close("cell")
            self._close("tr")
            row: list = []
            for name, item in self.open:
                if name == "table":
                    item.append(row)
            self.open.append(("tr", row))
        elif tag in ("td", "th"):
            self._close("cell")
            cell: tuple[list, list] = ([], [])
            for name, item in self.open:
                if name == "tr":
                    item.append(cell)
            self.open.append(("cell", cell))
        elif tag == "a" and (href := dict(attrs).get("href")) is not None:
            self.anchor = (href.strip(), [])
            for name, item in self.open:
                if name == "cell":
                    item[1].append(self.anchor)

    def handle_endtag(self, tag: str) -> None:
        if tag == "a":
            self.anchor = None
        elif tag in ("td", "th"):
            self._close("cell")
        elif tag == "tr":
            self._close("tr")
        elif tag == "table":
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == "table":
                    del self.open[i:]
                    return

    def handle_data(self, data: str) -> None:
        if text := " ".join(data.split()):
            if self.anchor:
                self.anchor[1].append(text)
            for name, item in self.open:
                if name == "cell":
                    item[0].append(text)


def header_names(cells: list) -> list[str | None]:
    """The field that each cell of a header row names, by the first list of needles that fits."""
    low = [" ".join(c[0]).strip().lower() for c in cells]
    return [next((field for field, needles in V.HEADER_HINTS.items() if any(n in text for n in needles)), None) for text in low]


@udtf(returnType="table: int, row: int, href: string, link_text: string, hints: map<string,string>")
class TableLinks:
    """The links of all table rows of a page, with what the header of the table says of the cells of their row."""

    def eval(self, html: str) -> Iterator[tuple]:
        parser = _Tables()
        parser.feed(html or "")
        parser.close()
        for t, rows in enumerate(parser.tables):
            fields = header_names(rows[0]) if rows else []
            for r, cells in enumerate(rows):
                hints = {field: " ".join(cell[0]) for field, cell in zip(fields, cells) if field and cell[0]}  # noqa: B905
                links: dict[int, tuple] = {id(a): a for cell in cells for a in cell[1]}
                for href, text in links.values():
                    if href and not href.lower().startswith("javascript:"):
                        yield t, r, href, " ".join(text), hints


def table_links(pages: DataFrame) -> DataFrame:
    """pages(page_id, url, html): (page_id, table, row, url, link_text, hints), each address once a page, where it stands first."""
    tables = pages.where(F.contains(F.lower("html"), F.lit("<table")))
    rows = tables.lateralJoin(TableLinks(F.col("html").outer())).withColumn("target", W.without_fragment(W.resolved(F.col("url"), F.col("href"))))
    place = Window.partitionBy("page_id", "target").orderBy("table", "row")
    return rows.withColumn("_n", F.row_number().over(place)).where("_n = 1").select("page_id", "table", "row", F.col("target").alias("url"), "link_text", "hints")


def listing_follow(pages: DataFrame, suffixes: tuple[str, ...] = SUFFIXES, blocked: tuple[str, ...] = BLOCKED) -> DataFrame:
    """(page_id, url): addresses of listing pages that a page leads to, on approved hosts, each once, other than the page itself."""
    rows = anchors(pages).where("href <> ''").where(~F.startswith(F.lower("href"), F.lit("javascript:")))
    rows = rows.withColumn("url", W.without_fragment(W.resolved(F.col("page_url"), F.col("href"))))
    fits = F.col("url").rlike(V.LISTING_PAGE) & W.approved(F.col("url"), suffixes, blocked) & ~W.is_document(F.col("url"), F.col("link_text"))
    return rows.where(fits & (F.col("url") != F.col("page_url"))).select("page_id", "url").distinct()


@C.query(
    """WITH o AS (SELECT o_orderkey // 10 AS page_id, o_orderkey AS k, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS go_date, 'G.O. No.' || o_orderkey AS go_number, o_orderpriority || ' with annex' AS subject FROM orders)
SELECT page_id, 'https://example.com/go/' || k || '.pdf' AS url, go_number AS link_text, go_date, go_number, subject FROM o
UNION ALL SELECT page_id, 'https://example.com/lists/annex/' || k || '.pdf', 'annex', go_date, go_number, subject FROM o"""
)
def table_harvest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing pages generated from orders: cells that are not closed, attributes without quotes, rows in comments, and a table in a cell."""
    k = F.col("o_orderkey").cast("string")
    row = F.concat(
        F.lit("<tr><td>"), F.to_date("o_orderdate").cast("string"), F.lit("<td><a class=x href=/go/"), k, F.lit(".pdf>G.O.&nbsp;No."), k, F.lit("</a>\n<td><b>"), F.col("o_orderpriority"),
        F.lit('</b><table><tr><td>with</td><td><a href="annex/'), k, F.lit('.pdf">annex</a></td></tr></table></td></tr><!-- <tr><td><a href="/go/0.pdf">old</a></td></tr> -->'),
    )
    o = load(spark, sf_dir, "orders")
    trs = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", row.alias("tr")))), lambda x: x["tr"]), "")
    html = F.concat(F.lit("<html><TABLE border=1><tr><th>Date<th>G.O. Number</th><th>Subject</tr>"), trs, F.lit("</TABLE></html>"))
    pages = o.groupBy(F.floor(F.col("o_orderkey") / 10).alias("page_id")).agg(html.alias("html")).withColumn("url", F.lit("https://example.com/lists/new"))
    hint = lambda f: F.col("hints")[f].alias(f)
    return table_links(pages).select("page_id", "url", "link_text", hint("go_date"), hint("go_number"), hint("subject"))


@C.query(
    """SELECT o_orderkey AS page_id, 'https://example.com/x/godept_list.php?dep_id=' || o_custkey AS url FROM orders
UNION ALL SELECT o_orderkey, 'https://example.com/whatsnew.php' FROM orders WHERE o_orderstatus <> 'F'"""
)
def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing pages that a listing page leads to; itself, other hosts and files are none."""
    a = lambda href: F.concat(F.lit('<a href="'), href, F.lit('">list</a>'))
    more = F.when(F.col("o_orderstatus") != "F", a(F.lit("../whatsnew.php"))).otherwise(a(F.lit("https://other.net/go.php")))
    html = F.concat(a(F.concat(F.lit("./godept_list.php?dep_id="), F.col("o_custkey").cast("string"), F.lit("#top"))), more, more, a(F.lit("go.php?file=a.pdf")), a(F.lit("go.php?n=1")))
    pages = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit("https://example.com/x/go.php?n=1").alias("url"), html.alias("html"))
    return listing_follow(pages)


QUERIES, ORACLE_SQL = C.queries, C.oracle_sql
