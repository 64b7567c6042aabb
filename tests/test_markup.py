"""The token stream against a tokenizer that walks a page byte by byte, broken pages, and the keyword automaton against plain search."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from hireatlas.functions import keywords as K, markup as M
from hireatlas.functions.html import links, visible_text

SPACES = b" \t\n\x0b\x0c\r"


def walk(page: bytes):
    """(start, stop, what) of each token, by walking the page; `what` is start, end or other with the lower-case name."""
    out, i, n = [], 0, len(page)
    while i < n:
        if page[i] != 0x3C or i + 1 == n or not (page[i + 1 : i + 2].isalpha() and page[i + 1] < 128 or page[i + 1] in b"/!?"):
            i += 1
            continue
        if page.startswith(b"<!--", i):
            end = page.find(b"-->", i + 4)
            stop = n if end < 0 else end + 3
            out.append((i, stop, ("other", b"")))
            i = stop
            continue
        if page.startswith(b"<![CDATA[", i):
            end = page.find(b"]]>", i + 9)
            stop = n if end < 0 else end + 3
            inner = n if end < 0 else end
            out.append((i, min(i + 9, inner), ("other", b"")))
            out.append((inner, stop, ("other", b"")))
            i = stop
            continue
        j, stop = i + 1, None
        while j < n:
            if page[j] == 0x3E:
                stop = j + 1
                break
            if page[j] == 0x3D:
                k = j + 1
                while k < n and page[k] in SPACES:
                    k += 1
                if k < n and page[k] in b"\"'":
                    close = page.find(page[k : k + 1], k + 1)
                    if close >= 0:
                        j = close + 1
                        continue
            j += 1
        closing = page[i + 1] == 0x2F
        a = i + 1 + closing
        b = a
        while b < n and page[b] not in SPACES + b"/>\0":
            b += 1
        name = page[a:b].lower()
        what = "end" if closing else "start" if page[i + 1 : i + 2].isalpha() else "other"
        raw = what == "start" and name in (b"script", b"style")
        if stop is None:
            if raw:
                out.append((i, n, (what, name)))
                break
            i += 1
            continue
        out.append((i, stop, (what, name)))
        i = stop
        if raw:
            found = n
            at = i
            while True:
                at = page.find(b"</", at)
                if at < 0:
                    break
                if page[at + 2 : at + 2 + len(name)].lower() == name and page[at + 2 + len(name) : at + 3 + len(name)] in (b"", b"\0", b"/", b">", *(bytes([s]) for s in SPACES)):
                    found = at
                    break
                at += 2
            i = found
    return out


def body_of(page: bytes, noscript: bool) -> str:
    import html

    tokens = [(0, 0, ("page", b"")), *walk(page)]
    texts, inside = [], False
    for (_, stop, (what, name)), after in zip(tokens, [t[0] for t in tokens[1:]] + [len(page)]):
        if name == b"noscript":
            inside = what == "start"
        if what == "start" and name in (b"script", b"style") or inside and not noscript:
            continue
        texts.append(html.unescape(page[stop:after].decode("utf-8", "replace")).strip())
    return " ".join(filter(None, texts))


PIECES = [
    "<", ">", "</", "<a", "<a href=", "<A HREF='", '"', "'", "=", " ", "\n", "<!--", "-->", "<![CDATA[", "]]>", "<!", "<?", "script", "<script>", "</script>", "<style", "</style >",
    "<noscript>", "</noscript>", "<title>", "</title>", "<h1>", "</h1 x>", "<p>", "</p>", "<br/>", "text", "é", "&amp;", "&nbsp;", "&lt", " = ", "='x>y'", '="q"', "/", "-", "<loc>", "</loc>", "\0",
]


def test_tokens_against_a_walk_over_the_page():
    draw = random.Random(11)
    pages = ["".join(draw.choice(PIECES) for _ in range(draw.randint(0, 60))) for _ in range(4000)]
    data = [p.encode() for p in pages]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    both = M.Pages(np.frombuffer(b"".join(data), np.uint8), offsets)
    t = both.tokens
    body, text = both.body(), both.text()
    for i, page in enumerate(data):
        a, b = t.first[i] + 1, t.first[i + 1]
        kinds = {M.START: "start", M.END: "end", M.OTHER: "other"}
        got = [(int(s - offsets[i]), int(e - offsets[i]), kinds[int(k)]) for s, e, k in zip(t.start[a:b], t.stop[a:b], t.kind[a:b])]
        assert got == [(s, e, what) for s, e, (what, _) in walk(page)], pages[i]
        assert body[i] == body_of(page, True), pages[i]
        assert text[i] == body_of(page, False), pages[i]
    both.links(), both.heading(), both.title(), both.data_blocks(), both.locations()


HOSTILE = ["<h1>", "<title>", "<loc>", "<script type='application/ld+json'>", "<a href='x'>", "<a href='x", "<!--", "<![CDATA[", "<noscript>", "<b ", '<p a="', '<p a="x" ', "='\"", "<h1><div>", "</p>", "<script ", "<style>", "&amp"]


@pytest.mark.parametrize("piece", HOSTILE)
def test_unclosed_tags_take_time_in_proportion(piece):
    names = tuple(M.PARTS)
    types = [M._ARROW[M.PARTS[n]] for n in names]

    def seconds(count):
        best = 9.0
        for _ in range(2):
            began = time.process_time()
            M.read_parts(pa.array([piece * count]), names, types)
            best = min(best, time.process_time() - began)
        return best

    small, large = seconds(10_000), seconds(100_000)
    assert large < 2.5 and large < 40 * small + 0.1


ELEMENTS = {
    "<div><h1>Cook<p>Text</p></div><p>after</p>": "Cook Text",
    "<h1>Cook": "Cook",
    "<h1>A <b>big</b> cook</h1><p>x": "A big cook",
    "<h1>one<br>two</p></h1>": "one two",
    "<h1><script>x()</script>Seen<noscript>too</noscript></h1>": "Seen too",
    "<h1></h1><h1>second</h1>": "",
    "<h1>outer <h1>inner</h1> rest</h1>": "outer inner rest",
    "<section><h1>in section</section>out": "in section",
    "<h1 title='a>b'>T&amp;C</h1>": "T&C",
    "<H1>Caps</H1>": "Caps",
    "<h10>no</h10>": None,
    "<!-- <h1>no</h1> --><script><h1>no</h1></script>": None,
}


def test_elements_end_with_their_parents(spark):
    df = spark.createDataFrame([(k, k) for k in ELEMENTS], "k string, html string")
    got = {r.k: r.h for r in df.select("k", M.page_parts(F.col("html"), "heading")["heading"].alias("h")).collect()}
    assert got == ELEMENTS


def test_blocks_and_locations(spark):
    page = (
        "<script type=\"application/ld+json\">{\"a\": \"</p>&amp;\"}</script><SCRIPT TYPE='application/LD+JSON; charset=utf-8' async>2</SCRIPT ><script>3</script>"
        "<script data-type='application/ld+json'>4</script><script async type=application/ld+json>5<!-- </script><script type='application/ld+json'>6"
    )
    xml = "<urlset><url><loc> https://a/1?x=1&amp;y=2 </loc></url><LOC><![CDATA[https://a/2?x&y]]></LOC><loc/><loc><!-- c -->https://a/3</url><loc>https://a/4"
    df = spark.createDataFrame([(page, xml), ("", ""), (None, None)], "html string, xml string")
    rows = df.select(M.page_parts(F.col("html"), "data_blocks")["data_blocks"].alias("b"), M.page_parts(F.col("xml"), "locations")["locations"].alias("l")).collect()
    assert rows[0].b == ['{"a": "</p>&amp;"}', "2", "5<!-- ", "6"]
    assert rows[0].l == ["https://a/1?x=1&y=2", "https://a/2?x&y", "https://a/3", "https://a/4"]
    assert (rows[1].b, rows[1].l, rows[2].b, rows[2].l) == ([], [], None, None)


def test_values_keep_parameters_that_look_like_references(spark):
    page = "<a href='/x?a=1&copy=2&lt;=3&#38;b&amp=1'>A&copy;&ampB</a><a href>none</a><a href=''>empty</a><a =x href=/y>odd</a>"
    got = spark.createDataFrame([(page,)], "html string").select(links(F.col("html")).alias("l")).first()["l"]
    assert [tuple(a) for a in got] == [("/x?a=1&copy=2<=3&b&amp=1", "a©&b"), ("", "empty"), ("/y", "odd")]


def test_rows_beyond_a_chunk_and_null_pages(spark):
    big = "<p>" + "word " * 300_000 + "</p>"
    df = spark.createDataFrame([(i, p) for i, p in enumerate([None, "", "<b>x</b>", big, None, "<i>y"])], "i int, html string")
    got = {r.i: r.t for r in df.select("i", visible_text(F.col("html")).alias("t")).collect()}
    assert got == {0: None, 1: "", 2: "x", 3: ("word " * 300_000).strip(), 4: None, 5: "y"}


def test_keywords_against_plain_search(spark):
    draw = random.Random(3)
    words = ["a", "ab", "bab", "é", "", "ab ", "🙂", "zz", "cookie", "cookies"]
    texts = [None, "", *("".join(draw.choice("ab é🙂z") for _ in range(draw.randint(1, 40))) for _ in range(300)), "we use cookies"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    places = K.keyword_places(F.col("x"), words)
    got = df.select("i", places.alias("p"), K.listed(places, words[::-1]).alias("l"), K.any_of(places, ["zz", "bab"]).alias("any")).collect()
    for r in got:
        text = texts[r.i] or ""
        assert r.p == {w: text.find(w) + 1 for w in words if w in text}
        assert r.l == [w for w in words[::-1] if w in text]
        assert r.any == ("zz" in text or "bab" in text)
    none = df.select(K.keyword_places(F.col("x"), []).alias("p")).first()
    assert none.p == {}


def test_excerpts_at_places_are_those_of_plain_search(spark):
    from hireatlas.functions.text import snippets
    from hireatlas.operators.once import compute_once

    words = ["apply", "open positions", "missing", "career"]
    texts = ["Open positions: apply now", "  apply  " + "x" * 200 + " career " + "y" * 300 + " open positions", "none", None, "Career apply career"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    rows = compute_once(df, {"p": K.keyword_places(F.lower("x"), words)})
    got = rows.select("i", K.snippets_at(F.col("x"), F.col("p"), words, 2, 20).alias("a"), snippets(F.col("x"), F.lower("x"), words, 2, 20).alias("b")).collect()
    assert all(r.a == (r.b or []) for r in got) and got[1].a[0].startswith("apply")
