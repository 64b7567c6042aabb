"""Scalar column functions on values with a known answer."""

import math
from urllib.parse import urljoin

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from hireatlas import rules
from hireatlas.functions import html as H, text as T, urls as U, values as V
from hireatlas.functions.geo import cell, haversine_km


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["_"]) if all(v is not None for v in values.values()) else spark.createDataFrame(
        [tuple(values.values())], ", ".join(f"{k} string" for k in values)
    )
    return df.select(column.alias("v")).first()["v"]


def many(spark, column, values, ddl="x string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {ddl}")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


def test_pick_first_skips_blank_and_null(spark):
    df = spark.createDataFrame([(None, "  ", " x ")], "a string, b string, c string")
    assert df.select(T.pick_first("a", "b", "c").alias("v")).first()["v"] == "x"
    assert df.select(T.pick_first("a", "b").alias("v")).first()["v"] == ""


def test_usable_rejects_spelled_out_nulls(spark):
    assert many(spark, T.usable("x"), ["NaN", "none", " null ", "", None, " ok "]) == [None, None, None, None, None, "ok"]


def test_fold_and_transliterate(spark):
    assert many(spark, T.fold_nordic("x"), [" Mäntsälä ", "ÅBO", None]) == ["mantsala", "abo", ""]
    assert many(spark, T.to_ascii(F.col("x")), ["Hämeentie, Łódź, Straße, Æbeltoft, Škoda"]) == ["Hameentie, Lodz, Strasse, AEbeltoft, Skoda"]


def test_tags_ordered_and_sorted(spark):
    assert many(spark, T.ordered_tags("x"), ["b; A,b ,", None]) == [["b", "a"], []]
    assert many(spark, T.sorted_tags("x"), ["b; A,b ,"]) == [["a", "b"]]


def test_detect_tags_in_rule_order(spark):
    got = many(spark, T.detect_tags(F.col("x"), rules.TAG_RULES), ["Salesforce data trainee", "Myyjä", None])
    assert got == [["trainee", "data", "salesforce"], [], []]


def test_snippets_window_and_distinct(spark):
    text = "a" * 100 + " apply now " + "b" * 100 + " career " + "c" * 5
    df = spark.createDataFrame([(text,)], "x string")
    got = df.select(T.snippets(F.col("x"), F.lower("x"), ["apply", "missing", "career"], 4).alias("v")).first()["v"]
    at = text.index("apply")
    assert got[0] == text[at - 80 : at + 80].strip()
    assert len(got) == 2
    short = spark.createDataFrame([("Open positions: apply now",)], "x string")
    assert short.select(T.snippets(F.col("x"), F.lower("x"), ["open positions", "apply"], 4).alias("v")).first()["v"] == ["Open positions: apply now"]


def test_haversine_and_missing_coordinates(spark):
    df = spark.createDataFrame([(60.1699, 24.9384, 60.1699, 24.9384), (60.0, 25.0, 61.0, 25.0), (None, 25.0, 61.0, 25.0)], "a double, b double, c double, d double")
    got = [r["v"] for r in df.select(haversine_km(*[F.col(c) for c in "abcd"]).alias("v")).collect()]
    assert got[0] == 0.0
    assert math.isclose(got[1], 111.195, abs_tol=0.01)
    assert got[2] is None


def test_close_points_share_or_touch_a_cell(spark):
    points = [(89.99, 0.0, 89.99, 180.0), (10.0, 179.99, 10.0, -179.99), (60.0, 25.0, 60.01, 25.02)]
    df = spark.createDataFrame(points, "a double, b double, c double, d double")
    got = df.select(haversine_km(*[F.col(c) for c in "abcd"]).alias("km"), cell(F.col("a"), F.col("b"), 5.0).alias("p"), cell(F.col("c"), F.col("d"), 5.0).alias("q")).collect()
    for r in got:
        assert r["km"] <= 5.0
        assert all(abs(r["p"][k] - r["q"][k]) <= 1 for k in "xyz")


def test_clean_domain(spark):
    got = many(spark, U.clean_domain("x"), ["https://www.A.fi:8080/x?y", "b.fi/path", " c.fi ", "nan", None, ""])
    assert got == ["www.A.fi:8080", "b.fi", "c.fi", "", "", ""]


HREFS = ["/jobs/1", "jobs/2", "../up", "./here", "?page=2", "#top", "//cdn.example/x", "https://other.example/y", "mailto:a@b.c", "", "../../../far/..", "a/b/../c/./d", "x?y=../z"]


@pytest.mark.parametrize("base", ["https://e.example/a/b/c.html?q=1", "http://e.example", "https://e.example/dir/", "https://e.example/x#frag"])
def test_resolve_url_agrees_with_the_standard_rules(spark, base):
    got = many(spark, U.resolve_url(F.lit(base), F.col("x")), HREFS)
    for href, mine in zip(HREFS, got):
        want = urljoin(base, href)
        # An empty path and the root path address the same page.
        assert mine.replace("e.example/?", "e.example?") == want.replace("e.example/?", "e.example?"), href


def test_url_classes(spark):
    urls = ["https://a.fi/jobs/", "https://a.fi/jobs/1", "https://a.fi", "https://a.fi/Team/x", "https://a.fi/x?category=1"]
    assert many(spark, U.is_listing_url(F.col("x")), urls) == [True, False, False, False, False]
    assert many(spark, U.is_non_job_url(F.col("x")), urls) == [False, False, False, True, True]


def test_party_and_board_hosts(spark):
    urls = ["https://jobs.a.fi/1", "a.fi", "https://nota.fi", "https://x.lever.co/1", "https://clever.co", ""]
    assert many(spark, U.is_first_party(F.col("x"), F.lit("A.fi")), urls) == [True, True, False, False, False, False]
    assert many(spark, U.is_ats_host(F.col("x")), urls) == [False, False, False, True, False, False]


def test_place_id(spark):
    urls = [
        "https://www.google.com/maps?q=1&place_id=AB%2F1",
        "https://maps.google.com/?query_place_id=Q1&placeid=P1",
        "https://www.google.com/maps/place/data=!3m1!1s0x46%3A0x1!8m2",
        "https://evil.example/?place_id=X",
        "https://goo.gl/maps/x",
    ]
    assert many(spark, U.place_id("x"), urls) == ["AB/1", "P1", "0x46:0x1", None, None]


def test_page_text_contract(spark):
    html = (
        "<html><head><title> A &amp; B </title><style>p{}</style><script>var t='</p>';</script></head><body><!-- no --><p title=\"a>b\">Hello\n<b>big</b>"
        "&nbsp;</p><noscript>off</noscript>5 < 6 &lt;tag&gt; &#228;&#x41; caf&eacute;</body></html>"
    )
    df = spark.createDataFrame([(html,)], "h string")
    row = df.select(H.title_text(F.col("h")).alias("t"), H.visible_text(F.col("h")).alias("v"), H.body_text(F.col("h")).alias("b")).first()
    assert row["t"] == "A & B"
    assert row["v"] == "A & B Hello big 5 < 6 <tag> äA café"
    assert "off" in row["b"]


def test_links_and_heading(spark):
    html = "<a class=x href=/one>One</a><A HREF='/t?a=1&amp;b=2'><b>Two</b> words</A><a name=z>no</a><!-- <a href='/c'>c</a> --><h1>Big <i>title</i></h1>"
    df = spark.createDataFrame([(html,)], "h string")
    row = df.select(H.links(F.col("h")).alias("l"), H.first_heading(F.col("h")).alias("t")).first()
    assert [(x["href"], x["text"]) for x in row["l"]] == [("/one", "one"), ("/t?a=1&b=2", "two words")]
    assert row["t"] == "Big title"


def test_posted_ts(spark):
    values = ["2024-01-02", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "1700000000000", "soon", "", None, "2024"]
    got = many(spark, F.date_format(V.posted_ts("x"), "yyyy-MM-dd HH:mm"), values)
    assert got == ["2024-01-02 00:00", "2024-01-02 03:04", "2024-01-02 01:04", "2023-11-14 22:13", None, None, None, None]


def test_coercions(spark):
    assert many(spark, V.parse_bool("x"), [" Yes", "0", "maybe", None]) == [True, False, None, None]
    assert many(spark, V.parse_number("x"), ["1.5 ", "NaN", "x", None]) == [1.5, None, None, None]
    assert many(spark, V.parse_list("x"), ['["a", "b"]', "a; b;", "", None, "[oops"]) == [["a", "b"], ["a", "b"], [], [], None]


def test_embedded_json(spark):
    values = ['{"a":"1"}', 'Well: {"a":"2"} there', "no { json", None]
    assert many(spark, V.json_text(V.embedded_json("x"), "$.a"), values) == ["1", "2", None, None]


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aAbB;, ä", max_size=12), min_size=1, max_size=6))
def test_sorted_tags_property(spark, values):
    got = many(spark, T.sorted_tags("x"), values)
    for raw, tags in zip(values, got):
        assert tags == sorted({p.strip().lower() for p in raw.replace(";", ",").split(",") if p.strip()})
