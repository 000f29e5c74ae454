import random
import re

import pytest
from pyspark.sql import functions as F

from millrace.llm import urls

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("a.b.c", "/x", "block"), ("c", "", "allow")]


def judge(url, rules):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


def sample():
    rng = random.Random(4)
    hosts = ["net", "x.net", "xnet", "EXAMPLE.net", "www.example.net", "example.com", "org", "q.org", "a.b.c", "z.a.b.c", "", "c", "..c", "a.b.c."]
    paths = ["", "/", "/en/", "/en", "/de/1", "/fr/?q=/en/", "/x#y", "/X", "/en/a?b", "?/en/", "#/"]
    out = [(i, rng.choice(["http://", "https://", "x://y://", "//", ""]) + rng.choice(hosts) + rng.choice(paths)) for i in range(400)]
    return out + [(1000, None), (None, "http://net/"), (1001, "http://net/"), (1001, "http://net/"), (1002, "http://a.net/\nen/")]


@pytest.mark.parametrize("options", [{}, {"max_blocks": 1}, {"broadcast_bytes": 0, "salts": 3}])
def test_as_brute_force(spark, options):
    pages = spark.createDataFrame([(*r, "x") for r in sample()], "page_id long, url string, key string")
    rules = spark.createDataFrame([*RULES, RULES[0], (None, "/", "block")], "host string, path string, verdict string")
    got = sorted(map(tuple, urls.url_filter(pages, rules, **options).collect()), key=str)
    assert got == sorted(((i, u, *judge(u, RULES)) for i, u in sample()), key=str)


def test_many_rules_have_no_false_positive(spark):
    rules = [(f"h{i}.com", f"/p{i % 7}", "block") for i in range(3000)]
    urls_ = [(i, f"http://w.h{i}.com/p{(i + i % 2) % 7}/q") for i in range(0, 6000, 3)]
    got = {r["page_id"]: r["rule"] for r in urls.url_filter(spark.createDataFrame(urls_, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"), max_blocks=8).collect()}
    exact = {(h, p) for h, p, _ in rules}
    assert got == {i: (f"h{i}.com/p{(i + i % 2) % 7}" if (f"h{i}.com", f"/p{(i + i % 2) % 7}") in exact else None) for i, _ in urls_}


def test_long_urls_and_many_copies(spark):
    long = "http://example.net/en/" + "a/" * 300_000
    rows = [(1, long), (2, "http://" + "x." * 20_000 + "net/q?" + "y" * 100_000), *[(3, "http://net/")] * 150_000]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    df = spark.createDataFrame(rows[:2], "page_id long, url string").unionByName(spark.range(150_000).select(F.lit(3).cast("long").alias("page_id"), F.lit("http://net/").alias("url")))
    got = {tuple(r) for r in urls.url_filter(df, rules).groupBy("page_id", "rule", "verdict").count().collect()}
    assert got == {(1, "example.net/en/", "allow", 1), (2, "net/", "block", 1), (3, "net/", "block", 150_000)}


def test_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert urls.url_filter(none, rules).count() == 0
    assert urls.url_filter(spark.createDataFrame([(1, "http://net/")], "page_id long, url string"), rules.limit(0)).head()["verdict"] == "allow"
