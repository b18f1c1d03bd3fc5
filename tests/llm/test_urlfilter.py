from tablewise.llm import urlfilter
from tablewise.llm.queries import URL_RULES

URLS = ["http://a.COM/x", "https://www.example.com/en/1?q=/de/", "http://example.com/en/2", "http://m.example.com/en/", "http://x.net/es/1", "http://net/fr/2#a",
        "http://b.com", None, "", "no scheme", "http://", "http://examplexcom/en/", "http://a.org/en/1", "http://y://z.com/a", "http://x.net/fr", "ftp://h.com:80/p\nq", "http://u@é.com/"]


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = rest[:min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]
    fits = [(len(p), p, v) for p, v in URL_RULES for h, _, q in [p.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + q)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_hosts_paths_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(0, URLS[0], "x", "y")], "page_id long, url string, rule string, host string")
    got = urlfilter.judge(pages, spark.createDataFrame(URL_RULES, "pattern string, verdict string")).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule, verdict = brute(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)


def test_learns_and_handles_empty(spark):
    rows = [(f"{'ads' if i % 3 == 0 else 'news'}{i}.org", f"/p/{i}", int(i % 3 == 0)) for i in range(300)]
    train = spark.createDataFrame(rows[:200], "host string, path string, blocked int")
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p, _) in enumerate(rows)], "page_id long, url string")
    rules = spark.createDataFrame([], "pattern string, verdict string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(pages, rules, labelled=train).collect()}
    assert sum((got[i] == "block") == bool(b) for i, (_, _, b) in enumerate(rows) if i >= 200) >= 98
    assert {r.verdict for r in urlfilter.judge(pages, rules).collect()} == {"allow"}
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
