"""URL filter: parts and rules against plain Python, reputations against plain formulas."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from folioscore.llm import url_filter as uf
from folioscore.llm.queries import URL_RULES

URLS = [
    "http://Www.Example.com/en/1?x=1#y", "https://example.com/en/", "https://a.example.com/en", "x://net/es/1",
    "https://b.net/fr/a/b#c", "ftp://user:pw@h.co.uk:80/p", "no scheme", None, "", "http://", "://", "http://B.ORG",
    "http://b.org?q=/en/", "a://b://c/d", "http://notexample.com/en/1", "http://xnet/es/", "http://127.0.0.1:8/x\ny",
]


def plain_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = rest[:cut], rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), tail[:end]


def plain_rule(host, path):
    fit = [
        (len(h + p), h + p, v)
        for v, h, p in URL_RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    return max(fit)[1:] if fit else (None, None)


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")


def test_parts_and_rules(spark):
    none = spark.createDataFrame([], "page_id long, bad int")
    got = uf.filter_urls(pages_of(spark, URLS), none, URL_RULES).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path = plain_parts(URLS[r["page_id"]])
        rule, verdict = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or "allow")


def test_domains(spark):
    hosts = ["a.b.example.com", "x.co.uk", "y.x.co.uk", "user@h.net:8080", "127.0.0.1:9", "com", "", "a.org."]
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    got = df.select(uf.registered_domain(F.col("h")), uf.public_suffix(F.col("h"))).collect()
    assert [tuple(r) for r in got] == [
        ("example.com", "com"), ("x.co.uk", "co.uk"), ("x.co.uk", "co.uk"), ("h.net", "net"), ("127.0.0.1", "1"),
        ("com", "com"), ("", ""), ("a.org", "org"),
    ]


def plain_strength(groups):
    seen = [(n, b) for n, b in groups if n]
    k, n = len(seen), sum(n for n, _ in seen)
    if k < 2 or n <= k:
        return 1.0
    rate = sum(b for _, b in seen) / n
    msb = sum(m * (b / m - rate) ** 2 for m, b in seen) / (k - 1)
    msw = sum(m * (b / m) * (1 - b / m) for m, b in seen) / (n - k)
    size = (n - sum(m * m for m, _ in seen) / n) / (k - 1)
    rho = round(min(max((msb - msw) / max(msb + (size - 1) * msw, 1e-12), 0.001), 0.5), 4)
    return (1 - rho) / rho


def test_reputation_equals_plain_formulas_and_blocks_bad_hosts(spark):
    urls, bad = [], []
    for i in range(600):
        host = ["good.a.com", "bad.a.com", "x.b.com", "y.c.net", "rare.a.com"][min(i % 5, 4) if i < 590 else 0]
        urls.append(f"http://{host}/{i}")
        bad.append(int(host == "bad.a.com" or (host == "x.b.com" and i % 10 == 2)))
    outcomes = spark.createDataFrame(
        [(i, b) for i, b in enumerate(bad) if i % 2] + [(9999, 1), (None, 1), (1, None)], "page_id long, bad int"
    )
    got = {r["page_id"]: r for r in uf.filter_urls(pages_of(spark, urls), outcomes).collect()}
    counts = defaultdict(lambda: [0, 0])
    for i, b in enumerate(bad):
        host = plain_parts(urls[i])[0]
        counts[host][0] += i % 2
        counts[host][1] += b * (i % 2)
    domains, suffixes = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for h, (n, b) in counts.items():
        for table, name in ((domains, ".".join(h.split(".")[-2:])), (suffixes, h.split(".")[-1])):
            table[name][0] += n
            table[name][1] += b
    n, b = (sum(c[i] for c in counts.values()) for i in (0, 1))
    ms, md, mh = (plain_strength(t.values()) for t in (suffixes, domains, counts))
    for r in got.values():
        h = r["host"]
        mean = (b + 1) / (n + 2)
        for m, (gn, gb) in ((ms, suffixes[h.split(".")[-1]]), (md, domains[".".join(h.split(".")[-2:])]), (mh, counts[h])):
            mean = (m * mean + gb) / (m + gn)
        bound = mean - 1.64 * math.sqrt(mean * (1 - mean) / (mh + counts[h][0] + 1))
        assert r["bad_mean"] == pytest.approx(mean, abs=2e-6)
        assert r["bad_bound"] == pytest.approx(bound, abs=2e-6)
        assert r["verdict"] == ("block" if bound > 0.5 else "allow")
    assert {r["host"] for r in got.values() if r["verdict"] == "block"} == {"bad.a.com"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, bad int")
    assert uf.filter_urls(pages_of(spark, []), none).collect() == []
    twice = spark.createDataFrame([(1, "http://a.b/"), (1, "http://a.b/")], "page_id long, url string")
    assert uf.filter_urls(twice, none).count() == 2
