import random

from folioquery.llm import url_filter as U


def expected(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:]
        path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[1] if best else None, best[2] if best else default


def test_against_brute_force(spark):
    r = random.Random(3)
    hosts = ["net", "example.net", "a.example.net", "EXAMPLE.com", "notexample.com", "org", "x.org", "b.a.x.org", "", "com"]
    paths = ["", "/", "/en/", "/en/x", "/EN/", "/de/y?z=/en/", "/fr/#top", "#/en/", "?q", "/fr", "/en/a/b"]
    urls = [f"{s}{r.choice(hosts)}{r.choice(paths)}" for s in ("http://", "https://", "", "x://") for _ in range(60)] + [None, "", "://", "://net/", "a://b://c/", "http://net./"]
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "x.org", ""), ("allow", "a.x.org", "/en/"), ("block", "example.net", "/en/a"), ("block", "org", "/"), ("allow", "net", "/en/")]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    for shards in (1, 5):
        out = U.filter_urls(df, spark.createDataFrame(rules, "action string, host string, path string"), shards=shards)
        assert {x["page_id"]: (x["host"], x["path"], x["rule"], x["verdict"]) for x in out.collect()} == {i: expected(u, rules) for i, u in enumerate(urls)}


def test_no_rules_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c"), (None, None)], "page_id long, url string")
    none = spark.createDataFrame([], "action string, host string, path string")
    out = U.filter_urls(df, none, default="block").collect()
    assert len(out) == 3 and all(x["rule"] is None and x["verdict"] == "block" for x in out)
    assert U.filter_urls(df.limit(0), none).count() == 0
    ties = spark.createDataFrame([("block", "b", None), ("allow", "b", ""), ("allow", None, "/")], "action string, host string, path string")
    assert {x["verdict"] for x in U.filter_urls(df.where("page_id = 1"), ties, default="block").collect()} == {"allow"}
