import random
from collections import deque
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from folioquery.functions import web as W
from folioquery.operators import claims, crawling, matching


def walked(start, pages, follow, most):
    """Requests of one source by a queue; a page is its status, or an error."""
    queue, seen, out, fetched = deque([start]), set(), [], 0
    while queue and fetched < most:
        url = queue.popleft()
        if url in seen:
            continue
        seen.add(url)
        answer = pages.get(url, "no such host")
        out.append((len(out) + 1, url, answer if isinstance(answer, int) else None, None if isinstance(answer, int) else answer))
        if not isinstance(answer, int):
            break
        fetched += 1
        if answer == 200:
            queue.extend(follow.get(url, []))
    return out


@pytest.mark.parametrize("most", [1, 3, 12])
def test_crawl_equals_a_queue(spark, most):
    r = random.Random(most)
    pages = {u: r.choice([200] * 8 + [404, "timed out"]) for u in range(60)}
    follow = {u: [r.randrange(64) for _ in range(r.choice([0, 2, 5, 9]))] for u in pages}
    follow[7] = list(range(60)) * 3  # more links than a crawl takes
    sources = [(s, s) for s in range(25)] + [(99, 500)]
    out = crawling.crawl_sources(
        spark.createDataFrame(sources, "source long, url long"),
        spark.createDataFrame([(u, a if isinstance(a, int) else None, None if isinstance(a, int) else a) for u, a in pages.items()], "url long, status int, error string"),
        spark.createDataFrame([(u, i, d) for u, ds in follow.items() for i, d in enumerate(ds)], "src long, turn long, dst long"),
        most,
    )
    want = sorted((s, *row) for s, u in sources for row in walked(u, pages, follow, most))
    assert sorted((x["source"], x["turn"], x["url"], x["status"], x["error"]) for x in out.collect()) == want


def test_run_counters(spark):
    requests = spark.createDataFrame([(1, 1, 10, 0, 200, None), (1, 2, 11, 1, 404, None), (1, 3, 12, 1, 200, None), (1, 4, 13, 1, None, "reset"), (2, 1, 10, 0, 200, None)], "source long, turn long, url long, hop long, status int, error string")
    documents = spark.createDataFrame([(10, "a"), (10, "b"), (11, "c"), (12, "a")], "url long, document string")
    out = {x["source"]: tuple(x)[1:] for x in crawling.crawl_runs_of(spark.createDataFrame([(1, 10), (2, 10), (3, 9)], "source long, url long"), requests, documents).collect()}
    assert out == {1: ("error", 3, 1, 3, 2, 1, "reset"), 2: ("ok", 1, 0, 2, 2, 0, None), 3: ("ok", 0, 0, 0, 0, 0, None)}


HTML = """<p><a href="/out.pdf">out</a></p><TABLE><tr><th>Order No<th>Dept.</th><th> Abstract </tr>
<tr><td><a href=one.pdf>One &amp; only</a><td>Works<td>roads <b>and</b> <table><tr><th>Date</th></tr><tr><td>1.2.2003 <a href='in.pdf'>inner</a></td></tr></table></td></tr>
<!-- <tr><td><a href="hidden.pdf">x</a></td></tr> --><tr><td><a href="javascript:go()">no</a> <a href="one.pdf#top">again</a></td></tr></table><table></table><table><tr><td>lonely <a name=x>y</a></table></td></tr>"""


def test_table_links(spark):
    pages = spark.createDataFrame([(1, "https://example.com/x/y", HTML), (2, "https://example.com/", "<p>no</p>"), (3, "https://example.com/", None)], "page_id long, url string, html string")
    out = {(x["page_id"], x["url"]): (x["table"], x["row"], x["link_text"], x["hints"]) for x in crawling.table_links(pages).collect()}
    hints = {"go_number": "One & only", "department": "Works", "subject": "roads and Date 1.2.2003 inner"}
    assert out == {(1, "https://example.com/x/one.pdf"): (0, 1, "One & only", hints), (1, "https://example.com/x/in.pdf"): (0, 1, "inner", hints)}
    parser = crawling._Tables()
    parser.feed(HTML)
    assert [len(t) for t in parser.tables] == [5, 2, 0, 1]  # rows of the inner table count in the outer one too
    assert crawling.header_names(parser.tables[1][0]) == ["go_date"]


def test_resolved_like_urljoin(spark):
    bases = ["https://a.b/c/d.html?x=1#f", "https://a.b", "https://a.b/", "http://a.b/c/d/", "https://a.b/c/../d/e"]
    hrefs = ["x.pdf", "./x.pdf", "../x.pdf", "../../x.pdf", "../../../../x.pdf", "y/./z/../x.pdf?q=../r#s", "..", ".", "y/..", "/./x/../z", "/../x", "?q=1", "#t", "", "//h/../x", "https://o/../x", ".x", "..x/y", "x..", "y/...", "a/b/../../../c"]
    rows = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    for x in rows.withColumn("got", W.resolved(F.col("b"), F.col("h"))).collect():
        if not x["h"].startswith(("https:", "//")):  # whole addresses are left as they are
            assert x["got"] == urljoin(x["b"], x["h"]).removesuffix("#") or (x["h"] == "" and x["got"] == x["b"]), x


def test_claims_of_stale_versions(spark):
    """Two agents: the second claims by what it saw before a release, and loses; a fresh look lets it win."""
    acts = [(1, 1, "claim", 7, 0), (1, 2, "claim", 8, 0), (1, 3, "claim", 8, 1), (1, 4, "progress", 8, 3), (1, 5, "progress", 7, 4), (1, 6, "release", 7, 5), (1, 7, "claim", 8, 5), (1, 8, "claim", 8, 6), (1, 9, "complete", 8, 8), (1, 10, "requeue", 9, 9), (2, 1, "complete", 1, 0)]
    df = spark.createDataFrame([(q, t, 10 * q + t, a, g, s) for q, t, a, g, s in reversed(acts)], "request long, turn long, action_id long, action string, agent long, seen long")
    out = [(x["outcome"], x["status"], x["version"], x["holder"]) for x in claims.outcomes(df).orderBy("request", "turn").collect()]
    assert out == [
        ("ok", "CLAIMED", 1, 7), ("stale", "CLAIMED", 1, 7), ("status", "CLAIMED", 1, 7), ("holder", "CLAIMED", 1, 7), ("ok", "RUNNING", 2, 7), ("ok", "QUEUED", 3, None),
        ("stale", "QUEUED", 3, None), ("ok", "CLAIMED", 4, 8), ("ok", "COMPLETED", 5, 8), ("ok", "QUEUED", 6, None), ("status", "QUEUED", 0, None),
    ]


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_overlap_join_equals_all_pairs(spark, least):
    r = random.Random(int(least * 10))
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(60)]
    text = lambda: " ".join(r.sample(common, r.randrange(0, 6)) + r.sample(rare, r.choice([0, 0, 1, 2, 7])))
    left = [(i, text()) for i in range(150)] + [(200 + i, "C0, c1 & r1!") for i in range(60)] + [(300, None), (301, "..."), (302, "only here")]
    right = [(i, text()) for i in range(80)] + [(100, left[0][1]), (101, "c0 c1 r1"), (102, "c0 c1 r1 r1"), (103, None)]
    words = lambda t: set("".join(c if c.isalnum() else " " for c in (t or "").lower()).split())
    want = []
    for i, a in left:
        for j, b in right:
            x, y = words(a), words(b)
            if x and y and len(x & y) >= least * len(x | y) - 1e-12:
                want.append((i, j, round(len(x & y) / len(x | y), 6)))
    sets = [matching.word_sets(spark.createDataFrame(rows, f"{k} long, t string"), k, "t") for rows, k in ((left, "a"), (right, "b"))]
    got = sorted(map(tuple, matching.overlapping(*sets, least).collect()))
    assert got == sorted(want) and len(want) > 60
