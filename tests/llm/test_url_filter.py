from hydrolake.llm import url_filter
from hydrolake.llm.queries import URL_RULES

URLS = [
    "https://example.com/en/1", "https://www.example.com/en/1", "https://a.www.example.com/en/", "http://x.example.com/en", "http://EXAMPLE.com/EN/1",
    "http://example.com", "http://example.com?q=/en/", "http://example.com/en/?a=http://b.net/es/", "ftp://a.net/es/x#y", "a.net/es/", "://", "http://", "",
    None, "http://net/fr/", "http://b.net/fr", "http://u:p@c.com:80/", "http://c.com/", "http://notexample.com/en/", "http://com/", "http://.com//", "http://a..com/ x",
    "http://a.net/es/x\ny", "http://ÄB.com/",
]


def expected(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    ends = [rest.find(c) for c in "/?#" if c in rest]
    host = rest[: min(ends)] if ends else rest
    path = rest[len(host) :]
    for c in "?#":
        path = path.split(c, 1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h.count("."), len(p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits)[2:] if fits else (None, "allow" if host else "block")
    return host, path, rule, verdict


def _pages(spark):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(0, URLS[0], "x", "y"), (None, URLS[1], "x", "y")], "page_id long, url string, rule string, host string")


def test_trie_and_join_give_what_the_rules_say(spark, monkeypatch):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = _pages(spark)
    want = sorted([(i, *expected(u)) for i, u in enumerate(URLS)] + [(0, *expected(URLS[0]))], key=repr) + [(None, *expected(URLS[1]))]
    got = [tuple(r) for r in url_filter.judge(pages, rules).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    monkeypatch.setattr(url_filter, "MAX_RULES", 2)
    assert sorted([tuple(r) for r in url_filter.judge(pages, rules).collect()], key=repr) == sorted(want, key=repr)


def test_rules_without_a_final_slash_and_conflicts(spark, monkeypatch):
    rules = spark.createDataFrame([("a.com", "/x", "block"), ("a.com", "/xy/", "allow"), ("b.com", "/", "allow"), ("b.com", "/", "block"), ("c.com", "", "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame(list(enumerate(["http://a.com/xz", "http://a.com/xy/1", "http://b.com/", "http://c.com?1", "http://a.com/"])), "page_id long, url string")
    want = ["block", "allow", "block", "allow", "allow"]
    for most in (100, 0):
        monkeypatch.setattr(url_filter, "MAX_RULES", most)
        assert [r["verdict"] for r in url_filter.judge(pages, rules).orderBy("page_id").collect()] == want


def test_empty_tables(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in url_filter.judge(_pages(spark), rules).collect()} == {"allow", "block"}
    assert url_filter.judge(_pages(spark).limit(0), rules).count() == 0
