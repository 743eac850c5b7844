import re

from pyspark.sql import functions as F

from inkshard.llm.plans import RULES
from inkshard.llm.urls import Cascade, judge_urls

URLS = [
    "http://EXAMPLE.org/es/x?y#z", "https://a.b.example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/", "http://x.com/fr/a", "http://x.com/de/", "http://com/de/q",
    "http://x.com?u=http://y.org/", "http://org", "http://org/", "//x.org/", "no url", "", None, "a://b://c.org/", "http://x.com/DE/", "http://.org/", "http://x.org:80/", "ftp://x.com/fr", "http://é.ORG/ü", "http://x.com/fr/\n/",
]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = "".join(c.lower() if c.isascii() else c for c in re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, key=lambda f: f[:2], default=(0, None, default))[1]
    verdicts = {v for _, r, v in fits if r == rule}
    return host, path, rule, default if rule is None else "block" if "block" in verdicts else "allow"


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls)], "page_id long, url string, rule string").repartition(3)
    got = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got.collect()} == {i: brute(u, rules) for i, u in enumerate(urls)}


def test_rules_of_the_query(spark):
    check(spark, URLS + URLS, RULES)


def test_other_rules(spark):
    check(spark, URLS, [("org", "", "block"), ("example.org", "/en/", "allow"), ("com", "/", "allow"), ("com", "/", "block"), ("x.com", "/d", "block"), (None, "/", "block"), ("b.example.org", "/en/12", "block")])
    check(spark, URLS, [(f"h{i}.org", f"/{i % 7}", ["allow", "block"][i % 2]) for i in range(200)])
    check(spark, [f"http://a.h{i}.org/{i % 9}/" for i in range(400)], [(f"h{i}.org", f"/{i % 7}", ["allow", "block"][i % 2]) for i in range(0, 400, 2)])


def test_no_rules_and_no_pages(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://x.org/")], "page_id long, url string")
    assert judge_urls(pages, rules).collect()[0].verdict == "allow"
    full = spark.createDataFrame(RULES, "host string, path string, verdict string")
    assert judge_urls(pages.filter("false"), full).collect() == []


def test_cascade_is_exact_over_its_universe(spark):
    keys = spark.range(60_000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), (F.col("id") % 13 == 0).alias("listed"))
    cascade = Cascade.of(keys.filter("listed"), keys.select("key"))
    assert len(cascade.levels) > 1
    assert keys.filter(cascade.holds(F.col("key")) != F.col("listed")).count() == 0
