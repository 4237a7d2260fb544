from lectern.llm import url_filter as U

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"), ("block", "a.b.c.org", "/fr/x")]


def brute(url, rules):
    rest = url[url.index("://") + 3 :] if url and "://" in url else ""
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
    rest = rest[n:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_against_brute_force(spark):
    urls = [
        None, "", "nothing", "http://", "https://Example.NET/en/1?x#y", "http://www.example.net/de/", "http://x.y.net", "http://net/",
        "http://.net/", "ftp://a.b.c.org/fr/xyz", "http://A.B.C.ORG/fr/y", "http://example.com/de/?q=/fr/", "http://example.com/DE/",
        "http://net:80/", "http://a://b.net/", "http://x.org/fr", "http://ünï.net/é", "http://" + "a." * 3000 + "net/", "http://org/fr/" + "p/" * 5000,
        "http://notexample.com/de/", "http://example.com#/de/",
    ]
    rows = [(i % 17, u, "h", "p", "r", "b") for i, u in enumerate(urls * 2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, path string, rule string, best string")
    found = U.judge_urls(pages, U.rule_table(spark, RULES)).collect()
    assert sorted(map(repr, [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in found])) == sorted(
        map(repr, [(i, *brute(u, RULES)) for i, u, *_ in rows])
    )


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    assert [r.verdict for r in U.judge_urls(pages, U.rule_table(spark, [])).collect()] == ["allow"]
    assert U.judge_urls(pages.limit(0), U.rule_table(spark)).count() == 0


def test_capitals_of_rules_and_urls_are_alike(spark):
    pages = spark.createDataFrame([(1, "http://É.Net/x"), (2, "http://é.net/x"), (3, "http://www.NET/")], "page_id long, url string")
    found = {r.page_id: r.rule for r in U.judge_urls(pages, U.rule_table(spark, [("block", "É.NET", "/"), ("block", "WWW.net", "/")])).collect()}
    assert found == {1: "É.net/", 2: None, 3: "www.net/"}
