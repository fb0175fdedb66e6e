import pytest

from volspark.llm import url_filter as U

URLS = ["http://a.example.org/es/1", "http://EXAMPLE.org/en/1x", "https://org/", "https://org", "http://xexample.org/es/", "http://x.com/fr/a?b", "http://x.com/de/", "ftp://x.com/d", None, "", "no scheme", "://", "http://a.org:80/x", "http://.org/x", "x://y://z/", "http://h.com/fr/\n", "http://a.com?/fr/"]
RULES = [*U.RULES, ("block", "com", "/fr/"), ("allow", None, "/"), ("block", "b.com", None)]


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        n = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
        path = rest[n:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


@pytest.mark.parametrize("bound", [100, 0])
def test_equals_brute_force(spark, bound):
    pages = spark.createDataFrame([(i, u, "c", "c") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string, path string")
    rules = spark.createDataFrame(RULES, "verdict string, host string, path string")
    rows = U.filter_urls(pages, rules, max_broadcast_rules=bound).collect()
    assert len(rows) == 2 * len(URLS)
    for r in rows:
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute((URLS + URLS)[r["page_id"]], RULES)


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(pages, U.rules_table(spark)).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    none = spark.createDataFrame([], "verdict string, host string, path string")
    assert [(r["rule"], r["verdict"]) for r in U.filter_urls(one, none).collect()] == [(None, "allow")]


def test_very_long_urls(spark):
    urls = ["http://" + "a." * 300_000 + "example.org/es/" + "x" * 500_000, "http://b.org/" + "y/" * 1_000_000 + "?q", "http://" + "c" * 1_000_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in U.filter_urls(pages, U.rules_table(spark)).collect():
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(urls[r["page_id"]], U.RULES)
