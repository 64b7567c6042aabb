"""The first prefix rule of each address, against a scan of the rule list."""

import random

from pyspark.sql import functions as F

from hireatlas.operators import crawl, prefixes

RULES = "host string, prefix string, ord int, allow boolean"


def plain(rules, host, text):
    hits = [(o, a, p == "") for h, p, o, a in rules if h == host and text.startswith(p)]
    return min(hits) if hits else None


def test_first_rules_equal_a_scan(spark):
    draw = random.Random(4)
    letters = "/ab%é😀"
    word = lambda n: "/" + "".join(draw.choice(letters) for _ in range(draw.randint(0, n)))
    rules = [(draw.choice(["a", "b", "c"]), draw.choice(["", "/", *[word(4)] * 6]), i, draw.random() < 0.5) for i in range(150)]
    texts = {(draw.choice(["a", "b", "c", "d"]), word(9)) for _ in range(600)} | {("a", ""), ("b", "/")}
    df = spark.createDataFrame(sorted(texts), "host string, text string")
    for parts in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {(r.host, r.text): tuple(r["first"]) if r["first"] else None for r in prefixes.first_rules(df, spark.createDataFrame(rules, RULES)).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert got == {(h, t): plain(rules, h, t) for h, t in texts}


def test_one_host_with_100_000_rules(spark):
    rules = spark.range(100_000).select(
        F.lit("Big.fi").alias("host"), F.concat(F.lit("/s"), (F.col("id") % 317).cast("string"), F.when(F.col("id") >= 317, F.concat(F.lit("/p"), F.col("id").cast("string"), F.lit("/"))).otherwise("")).alias("path_prefix"),
        F.col("id").cast("int").alias("ord"), (F.col("id") % 2 == 0).alias("allow"), F.lit(None).cast("string").alias("site_state"),
    )
    pages = spark.range(20_000).select("id", F.concat(F.lit("https://big.fi/s"), (F.col("id") % 400).cast("string"), F.lit("/p"), F.col("id").cast("string"), F.lit("/x?q=1")).alias("url"))
    got = crawl.access_gate(pages, rules).groupBy((F.col("id") % 400).alias("k")).agg(F.count_if("allowed").alias("open"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in got) == 20_000
    # "/s1" is listed first and starts "/s1..." too, so the least number that begins the site's decides.
    for r in got:
        first = min((int(str(r.k)[:i]) for i in range(1, 4) if int(str(r.k)[:i]) < 317), default=None)
        assert r.open == (r.n if first is None or first % 2 == 0 else 0), r


def test_no_rules_and_odd_rows(spark):
    pages = spark.createDataFrame([(1, "https://a.fi/x"), (2, None), (3, "no address")], "id int, url string")
    none = spark.createDataFrame([], "host string, path_prefix string, ord int, allow boolean, site_state string")
    assert [r.allowed for r in crawl.access_gate(pages, none).orderBy("id").collect()] == [True, True, True]
    only_state = spark.createDataFrame([("a.fi", None, 1, None, "unreachable"), (None, "/", 2, False, None)], none.schema)
    assert [r.skip_reason for r in crawl.access_gate(pages, only_state).orderBy("id").collect()] == ["robots_unavailable", "", ""]
    assert crawl.access_gate(pages.limit(0), only_state).count() == 0
