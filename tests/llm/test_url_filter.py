import random

from tendersieve.llm.url_filter import filter_urls

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/"), ("allow", "b.org", "/a/b"), ("block", "b.org", "/a/")]


def judge(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
        path = rest.split("?")[0].split("#")[0]
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: (r[1].count("."), len(r[2])), default=None)
    return host, path, best and best[1] + best[2], best[0] if best else "allow"


def test_against_brute_force(spark):
    rng = random.Random(3)
    urls = [None, "", "no-scheme.com/en/", "http://", "://COM/en/?q", "http://É.com", "http://com?x/en/", "http://example.com#/en/", "http://a://b.org/a/b", "http://x.b.org/a/bc\n/d"]
    for _ in range(300):
        host = rng.choice(["com", "Example.COM", "a.example.com", "xcom", "net", "EXAMPLE.net", "b.org", "z.b.org", "org"])
        urls.append("http://" + host + rng.choice(["", "/", "?", "#"]) + rng.choice(["en/", "/en/7", "/en/71/", "/de/8", "/de/9", "/a/b", "a/", "a", "/a/x", "/en"]) + rng.choice(["", "?a=/en/", "#b"]))
    pages = spark.createDataFrame([(i, u, "old", 3) for i, u in enumerate(urls)], "page_id long, url string, host string, extra int")
    out = filter_urls(pages, RULES)
    assert out.columns == ["page_id", "url", "extra", "host", "path", "rule", "verdict"]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    for i, u in enumerate(urls):
        assert got[i] == judge(u), u
    assert filter_urls(pages.limit(0), RULES).count() == 0
