import random

from fairlead.llm import url_filter
from fairlead.llm.url_filter import Rule

RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/"), Rule("block", "a.b.org", ""), Rule("allow", "a.b.org", "/x/y"), Rule("block", "a.b.org", "/x/y"), Rule("allow", "b.org", "/x/yz/")]


def expected(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        k = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:k]), rest[k:]
        path = rest[: next((i for i, c in enumerate(rest) if c in "?#"), len(rest))]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.verdict == "block"), default=None)
    return host, path, best.name if best else None, best.verdict if best else "allow"


def test_same_as_trying_every_rule(spark):
    rng = random.Random(1)
    hosts = ["net", "example.net", "EXAMPLE.com", "a.b.org", "x.a.b.org", "b.org", ".net", "n.et", "xnet", "example.net:80", "u@org", "", "É.org", "a..net"]
    paths = ["", "/", "/en", "/en/", "/EN/", "/en/x", "/de/1?q=/fr/", "#/en/", "?/en/", "/fr/#x", "/x/y", "/x/yz", "/x/yz/1", "/x", "//en/", "/x/y/z"]
    urls = [f"{s}{h}{p}" for s in ("http://", "://", "a://b://", "") for h in hosts for p in paths] + [None, "", "://", "http:/net/", "ftp://net/" + "x" * 50_000]
    rng.shuffle(urls)
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'c' AS host", "'c' AS path", "'c' AS rule", "'c' AS verdict", "'c' AS _url")
    want = [(i, *expected(u, RULES)) for i, u in enumerate(urls)]
    assert sorted(map(tuple, url_filter.filter_urls(pages, RULES).collect())) == want
    assert sorted(map(tuple, url_filter.filter_urls(pages, RULES, most_broadcast=0).collect())) == want
    assert url_filter.filter_urls(pages.limit(0), RULES).collect() == []
    assert url_filter.filter_urls(pages.union(pages), RULES).count() == 2 * len(urls)
