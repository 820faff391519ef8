"""URL rules against trying every rule on every URL."""

import random

import compare
from pyspark.sql import functions as F

from veilframe.llm.queries import QUERIES
from veilframe.llm.url_rules import judge_urls

SMALL = "/root/testdata/sf0.001"

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    end = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:end]


def plain(url, rules):
    host, path = parts(url)
    best = None
    for h, p, v in rules:
        if (h == "" or host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (), (len(h + p), h.count(".") + 1 if h else 0, h + p, v))
    return (host, path, best[2], best[3]) if best else (host, path, None, "allow")


def judged(spark, urls, rules):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    rows = judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows}


def test_all_rules(spark):
    rng = random.Random(3)
    hosts = ["com", "example.com", "WWW.Example.com", "a.www.example.com", "x.net", "net", "b.x.net", "org", "community", "example.com:80", "", "a..com", ".com"]
    paths = ["", "/", "/en/", "/en/x/y", "/en", "/es/1", "/fr/", "/Es/", "/es/?q=/fr/", "?x=/en/", "#/en/", "/en/#a://b"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme/en/", "://net/es/", "x://y://net/es/", "http://", "http://" + "a." * 3000 + "net/es/" + "z" * 5000]
    urls += ["https://hot.example.net/es/1"] * 2000
    rng.shuffle(urls)
    got = judged(spark, urls, RULES)
    assert got == {i: plain(u, RULES) for i, u in enumerate(urls)}


def test_many_nested_rules_over_many_ranges(spark):
    rng = random.Random(5)
    name = lambda: ".".join(rng.choice("abc") for _ in range(rng.randint(0, 4)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 6)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((name(), rng.choice(["", path()])) for _ in range(400))}.values())
    urls = [f"http://{name()}{path()}" for _ in range(3000)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that intervals reach over ranges
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        got = judged(spark, urls, rules)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_odd_rules_and_columns(spark):
    rules = [("net", None, "allow"), ("net", None, "block"), (None, "/", "block"), ("org", "/", None), ("", "/all", "block")]
    kept = [("net", "", "block"), ("", "/all", "block")]
    urls = ["http://a.net", "http://org/", "http://b.org/all/1", None]
    assert judged(spark, urls, rules) == {i: plain(u, kept) for i, u in enumerate(urls)}
    clash = spark.createDataFrame([(None, "http://a.net/es/", "h", 1), (7, None, None, 2), (7, None, None, 2)], "rule long, url string, host string, row int")
    out = judge_urls(clash, spark.createDataFrame(RULES, "host string, path string, verdict string"), id_column="rule", carry=("host", "row"))
    assert out.columns == ["rule", "host", "row", "host_2", "path", "rule_2", "verdict"]
    assert sorted(map(str, out.collect())) == sorted(map(str, [
        out.select(F.lit(None).cast("long").alias("rule"), F.lit("h").alias("host"), F.lit(1).alias("row"), F.lit("a.net").alias("host_2"), F.lit("/es/").alias("path"), F.lit("net/es/").alias("rule_2"), F.lit("block").alias("verdict")).first(),
        *[out.select(F.lit(7).cast("long").alias("rule"), F.lit(None).alias("host"), F.lit(2).alias("row"), F.lit("").alias("host_2"), F.lit("").alias("path"), F.lit(None).alias("rule_2"), F.lit("allow").alias("verdict")).first()] * 2,
    ]))


def test_empty(spark):
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert judged(spark, ["http://a.com/"], [("com", "/", "block")]) == {0: ("a.com", "/", "com/", "block")}
    pages = spark.createDataFrame([(1, "http://a.com/x")], "page_id long, url string")
    assert [tuple(r) for r in judge_urls(pages, none).collect()] == [(1, "a.com", "/x", None, "allow")]
    assert judge_urls(pages.limit(0), spark.createDataFrame(RULES, none.schema)).collect() == []


def test_query_against_sql(spark):
    assert compare.compare(spark, compare.connect(SMALL), QUERIES["op12_url_intervals"], SMALL) is None
