import random
import re

import pytest
from pyspark.sql import functions as F

from vigil.llm import url_filter

URLS = [
    None, "", "no scheme", "http://", "https://org", "https://ORG/", "http://a.example.org/es/1?x#y", "http://example.org/es", "http://EXAMPLE.org/en/17", "http://x.example.org/en/2", "http://notexample.org/en/1",
    "ftp://shop.com/fr/", "http://shop.com/de/x", "http://com/de/", "http://m.spam-farm.example.net/q", "http://spam-farm.example.net?q=/es/", "http://m.spam-farm.example.org/", "a://b://c.org/x", "http://x.org\n/y", "//x.org/", "http://a..org/", "http://free-bets.example.com/fr/1",
]


def plain(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    under = lambda h: host == h or host.endswith("." + h)
    fits = [(len(r), v, r) for v, r in url_filter.RULES if under(r[: r.index("/")]) and path.startswith(r[r.index("/") :])]
    if fits:
        return host, path, max(fits)[2], max(fits)[1]
    spam = any(map(under, url_filter.LISTED_HOSTS.read_text().split()[1:]))
    return host, path, None, "block" if spam else "allow"


def test_verdicts(spark):
    pages = spark.createDataFrame([(i, u, "x", "h") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string, key string")
    out = {r.page_id: r for r in url_filter.judge_urls(pages, url_filter.RULES, url_filter.listed_hosts(spark)).collect()}
    for i, u in enumerate(URLS + URLS):
        r = out[i]
        assert (r.host, r.path, r.rule, r.verdict) == plain(u), u
    assert url_filter.judge_urls(pages.limit(0), url_filter.RULES, url_filter.listed_hosts(spark)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_cascades_are_exact_over_the_universe(spark, seed):
    r = random.Random(seed)
    universe = [f"k{seed}-{i}" for i in range(5000)]
    listed = set(r.sample(universe, 300)) | {"elsewhere"}
    frame = lambda x: spark.createDataFrame([(k,) for k in x] + [(None,)], "key string")
    cascade = url_filter.fit_cascade(frame(listed), frame(universe + universe[:50]))
    assert len(cascade.levels) > 1
    hit = cascade.contains(F.col("key"))
    got = {x.key: x.hit for x in frame(universe + ["elsewhere"]).select("key", hit.alias("hit")).collect()}
    assert got == {k: k in listed for k in [*universe, "elsewhere"]} | {None: False}
    assert not url_filter.fit_cascade(frame([]), frame(universe)).levels
    assert url_filter.fit_cascade(frame(listed), frame(universe), max_bytes=100) is None


def test_size_follows_the_listed_keys(spark):
    """A million keys that are not listed lengthen the first level by a hash for each doubling, and no other level."""
    listed = spark.range(1000).selectExpr("concat('l', id) AS key")
    bits = []
    for n in (10_000, 1_000_000):
        cascade = url_filter.fit_cascade(listed, spark.range(n).selectExpr("concat('u', id) AS key"))
        bits.append([x.bits for x in cascade.levels])
        assert sum(bits[-1]) < 1000 * (1.5 * (n // 1000).bit_length() + 8)
    assert bits[1][0] > bits[0][0] and sum(bits[1][1:]) < 4000 and sum(bits[0][1:]) < 4000
    hit = cascade.contains(F.col("key"))
    assert spark.range(1_000_000).selectExpr("concat('u', id) AS key").union(listed).where(hit).count() == 1000


def test_long_lists_are_joined(spark):
    pages = spark.createDataFrame([(i, u, "x", "h") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string, key string")
    hosts = url_filter.listed_hosts(spark)
    assert sorted(url_filter.judge_urls(pages, url_filter.RULES, hosts, max_bytes=1).collect(), key=str) == sorted(url_filter.judge_urls(pages, url_filter.RULES, hosts).collect(), key=str)


def test_very_long_urls(spark):
    long = "http://" + "a." * 300 + "spam-farm.example.com/" + "x" * 200_000
    pages = spark.createDataFrame([(1, long), (2, "http://" + "y" * 100_000)], "page_id long, url string")
    out = {r.page_id: r for r in url_filter.judge_urls(pages, url_filter.RULES, url_filter.listed_hosts(spark)).collect()}
    assert out[1].verdict == "block" and len(out[1].path) == 200_001 and out[2].verdict == "allow"


def test_no_python_in_the_plan(spark):
    pages = spark.range(2).selectExpr("id AS page_id", "'http://a.org/' AS url")
    plan = url_filter.judge_urls(pages, url_filter.RULES, url_filter.listed_hosts(spark))._jdf.queryExecution().toString()
    assert not re.search("EvalPython|MapIn|Pandas", plan)
