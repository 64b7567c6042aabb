import json

from pyspark.sql import functions as F

from hireatlas.functions import html as H
from hireatlas.operators import analytics as A, contract, extraction as X, pages as P, signal as S
from hireatlas.plans import hiring

PAGE = "page_id long, url string, html string, business_id string, name string, domain string"


def page(i, html, url=None, **values):
    return {"page_id": i, "url": url or f"https://a.fi/p{i}", "html": html, "business_id": "1", "name": "A", "domain": "a.fi"} | values


LABELLED = [
    ("yes_list", "yes", "<html><head><title>Careers</title></head><body><h1>Open positions</h1><p>Apply today and join us.</p></body></html>"),
    ("yes_data", "yes", "<html><head><title>Jobs</title></head><body><script type='application/ld+json'>{\"@type\":\"JobPosting\",\"title\":\"Cook\"}</script><p>A cook is wanted.</p></body></html>"),
    ("yes_board", "yes", "<html><body><a href='https://boards.greenhouse.io/fjordbakery'>Careers</a></body></html>"),
    ("yes_finnish", "yes", "<html><head><title>Tyopaikat</title></head><body><h1>Avoimet tyopaikat</h1><p>Hae tahan.</p></body></html>"),
    ("no_about", "no", "<html><head><title>About</title></head><body><p>We repair bicycles.</p></body></html>"),
    ("unclear_home", "unclear", "<html><head><title>Welcome</title></head><body><p>Welcome in.</p></body></html>"),
]


def test_labelled_pages_give_the_expected_verdicts_and_metrics(rows):
    df = rows("page_id long, url string, html string, label string", [{"page_id": i, "url": f"https://example.com/{n}.html", "html": h, "label": t} for i, (n, t, h) in enumerate(LABELLED)])
    out = S.page_verdict(df)
    got = [r["signal"] for r in out.orderBy("page_id").collect()]
    assert got == ["unclear", "yes", "yes", "unclear", "unclear", "unclear"]
    m = A.classifier_metrics(out.withColumnRenamed("signal", "predicted")).first()
    assert [round(m[c], 2) for c in ("accuracy", "precision", "recall", "uncertain_rate")] == [0.5, 1.0, 0.5, 0.67]


def test_golden_texts(rows):
    golden = [("https://example.com/careers", "Open positions: apply today.", "yes"), ("https://example.com/about", "We repair bicycles.", "no"), ("https://boards.greenhouse.io/fjordbakery", "Careers portal.", "yes"), ("https://example.com/news", "Press releases.", "no")]
    df = rows("page_id long, url string, html string, label string", [{"page_id": i, "url": u, "html": f"<html><body>{t}</body></html>", "label": lab} for i, (u, t, lab) in enumerate(golden)])
    out = S.page_verdict(df)
    assert [r["signal"] for r in out.orderBy("page_id").collect()] == ["unclear", "unclear", "yes", "unclear"]
    m = A.classifier_metrics(out.withColumnRenamed("signal", "predicted")).first()
    assert [round(m[c], 2) for c in ("accuracy", "precision", "recall", "uncertain_rate")] == [0.25, 1.0, 0.5, 0.75]


def test_long_page_with_keywords_is_a_yes(rows):
    html = "<p>Open positions in our team.</p>" + "<p>filler words here</p>" * 20 + "<p>Apply through the form.</p>" + "<p>more filler</p>" * 20 + "<p>Career stories</p>"
    r = S.page_verdict(rows(PAGE, [page(1, html)])).first()
    assert (r["signal"], r["confidence"], r["evidence"], r["evidence_urls"]) == ("yes", 0.7, "job_signal_keywords", ["https://a.fi/p1"])
    assert len(r["evidence_snippets"]) == 3


def test_board_detection(rows):
    cases = [
        ("https://jobs.lever.co/fjordbakery/1", "", ("lever", "fjordbakery")), ("https://www.clever.com/x", "", None), ("https://a.fi", "<script src='https://hire.lever.co/x'>", ("lever", "hire")),
        ("https://boards.greenhouse.io/fjordbakery", "", ("greenhouse", "fjordbakery")), ("https://a.fi", "boards.greenhouse.io/z", ("greenhouse", None)), ("https://fjordbakery.recruitee.com/o/1", "", ("recruitee", "fjordbakery")),
        ("https://fjordbakery.teamtailor.com", "", ("teamtailor", "fjordbakery")), ("https://a.fi", "nothing", None),
    ]
    df = rows("id long, url string, html string", [{"id": i, "url": u, "html": h} for i, (u, h, _) in enumerate(cases)])
    got = [tuple(r["a"]) if r["a"] else None for r in df.orderBy("id").select(P.detect_ats(F.col("url"), F.col("html")).alias("a")).collect()]
    assert got == [want for _, _, want in cases]
    loose = df.where("id = 1").select(P.detect_ats(F.col("url"), F.col("html"), bare_substring=True).alias("a")).first()["a"]
    assert loose["kind"] == "lever"
    links = ["https://boards.greenhouse.io/a", "https://jobs.lever.co/a", "https://x.smartrecruiters.com/", "https://a.fi"]
    df = rows("id long, l string", [{"id": i, "l": x} for i, x in enumerate(links)])
    assert [r["k"] for r in df.orderBy("id").select(P.ats_link_kind(F.col("l")).alias("k")).collect()] == ["greenhouse", "lever", "smartrecruiters", None]


def test_cookie_wall_and_consent(rows):
    short, long = "<title>Hi</title><p>We use cookies. Accept all or manage preferences.</p>", "<p>one cookie</p>" + "<p>long text of the page</p>" * 200
    df = rows(PAGE, [page(1, short), page(2, long), page(3, "<p>nothing</p>"), page(4, "<p>cookie consent</p>")])
    out = {r["page_id"]: r for r in P.cookie_wall(P.page_text(df)).collect()}
    assert out[1]["is_wall"] and out[1]["wall_matches"][:3] == ["cookie", "cookies", "we use cookies"] and out[1]["wall_signals"] == ["cookie_banner", "consent_manager", "cookie_actions"]
    assert (out[2]["is_wall"], out[2]["wall_hits"], out[3]["wall_score"]) == (False, 1, 0.0)
    assert {r["page_id"]: r["is_consent"] for r in P.consent_pages(df).collect()} == {1: True, 2: False, 3: False, 4: True}


def test_sitemap_and_links(rows):
    xml = "<urlset><url><loc> https://a.fi/jobs/1 </loc></url><url><loc>https://a.fi/about</loc></url><url><loc>https://a.fi/ura?x=1&amp;y=2</loc></url></urlset>"
    got = P.sitemap_urls(rows("domain string, xml string", [{"domain": "a.fi", "xml": xml}])).orderBy("ord").collect()
    assert [r["url"] for r in got] == ["https://a.fi/jobs/1", "https://a.fi/ura?x=1&y=2"]
    html = "<a href='/jobs/1'>x</a><a href='/x'>Apply now</a><a href='/jobs/1'>again</a><a href='/other'>other</a>"
    got = P.page_links(rows(PAGE, [page(1, html)]), ["/jobs"], ["apply"]).orderBy("ord").collect()
    assert [r["target"] for r in got] == ["https://a.fi/jobs/1", "https://a.fi/x"]


def test_structured_postings(rows):
    html = """<script type="application/ld+json">{"@type":"JobPosting","title":"Junior Cook","url":"/jobs/1","description":"<p>Oppisopimus</p>","jobLocation":{"address":{"addressLocality":"Espoo"}},"employmentType":"full-time","datePosted":"2024-01-01"}</script>
    <script type='application/ld+json'>{"@graph":[{"@type":["JobPosting"],"title":"Data Chef","mainEntityOfPage":"https://b.fi/2","jobLocation":{"address":{"streetAddress":"Katu 1"}},"employmentType":["x"]},{"@type":"Person"}, 5]}</script>
    <script type="application/ld+json">[{"@type":"JobPosting","title":"Third"},{"@type":"Thing"}]</script><script type="application/ld+json">{oops</script><script>{"@type":"JobPosting"}</script>"""
    out = {r["job_title"]: r for r in X.jobs_from_json_ld(rows(PAGE, [page(1, html), page(2, "<p>none</p>")]), "now").collect()}
    assert set(out) == {"Junior Cook", "Data Chef", "Third"}
    a, b, c = out["Junior Cook"], out["Data Chef"], out["Third"]
    assert (a["job_url"], a["location_text"], a["employment_type"], a["description_snippet"], a["tags"], a["source"]) == ("https://a.fi/jobs/1", "Espoo", "full-time", "Oppisopimus", ["oppisopimus", "junior"], "jsonld")
    assert (b["job_url"], b["location_text"], b["employment_type"], b["tags"]) == ("https://b.fi/2", "Katu 1", None, ["data"])
    assert c["job_url"] == "https://a.fi/p1"


def test_generic_postings_count_what_they_skip(rows):
    lists = rows(PAGE, [page(1, "<a href='/jobs/1'>Cook</a><a href='/jobs/1/'>Cook again</a><a href='/jobs'>All jobs</a><a href='/team/jobs'>Team</a><a href='/jobs/wall'>W</a><a href='/jobs/lost'>L</a>")])
    details = rows("page_id long, url string, html string", [{"page_id": 10, "url": "https://a.fi/jobs/1", "html": "<h1>Data cook</h1><p>Body text</p>"}, {"page_id": 11, "url": "https://a.fi/jobs/wall", "html": "<p>cookie consent</p>"}])
    jobs, errors = X.generic_jobs(lists, details, "now")
    out = jobs.collect()
    assert [(r["job_title"], r["job_url"], r["description_snippet"], r["tags"], r["company_business_id"]) for r in out] == [("Data cook", "https://a.fi/jobs/1", "Data cook Body text", ["data"], "1")]
    assert sorted(r["error"] for r in errors.collect()) == ["cookie_consent", "listing_url_skipped", "non_job_url_skipped"]


def test_board_feeds(rows):
    feeds = [
        {"kind": "lever", "payload": json.dumps([{"text": "Cook", "hostedUrl": "https://l/1", "categories": {"location": "Lahti", "commitment": "Full"}, "descriptionPlain": "data", "createdAt": 1700000000000}])},
        {"kind": "greenhouse", "payload": json.dumps({"jobs": [{"title": "Chef", "absolute_url": "https://g/1", "location": {"name": "Espoo"}, "updated_at": "2024-01-01", "content": "<b>x</b>"}]})},
        {"kind": "recruitee", "payload": json.dumps({"offers": [{"title": "Baker", "url": "https://r/1", "location": "Turku", "created_at": "2024-01-02"}]})},
        {"kind": "teamtailor", "payload": "{}"}, {"kind": "lever", "payload": "broken"},
    ]
    df = rows("kind string, business_id string, name string, domain string, payload string", [f | {"business_id": "1"} for f in feeds])
    out = {r["source"]: r for r in X.jobs_from_feeds(df, "now").collect()}
    assert {k: (r["job_title"], r["job_url"], r["location_text"], r["posted_date"]) for k, r in out.items()} == {
        "lever": ("Cook", "https://l/1", "Lahti", "1700000000000"), "greenhouse": ("Chef", "https://g/1", "Espoo", "2024-01-01"), "recruitee": ("Baker", "https://r/1", "Turku", "2024-01-02"),
    }
    assert out["lever"]["tags"] == ["data"] and out["greenhouse"]["description_snippet"] == "x"


VERDICT = "id long, business_id string, ord long, signal string, confidence double, evidence string, evidence_snippets array<string>, evidence_urls array<string>"


def test_evidence_gate(rows):
    cases = [
        ("yes", ["we are hiring", "open roles"], ["u"], "yes"), ("YES", ["we are hiring"], ["u"], "unclear"), ("yes", ["we are hiring", "open roles"], [" "], "unclear"),
        ("yes", ["nice people", "good coffee"], ["u"], "unclear"), ("no", ["no vacancies", "closed"], ["u"], "no"), ("no", ["about", "us"], ["u"], "unclear"), ("unclear", [], [], "unclear"),
    ]
    df = rows(VERDICT, [{"id": i, "signal": s, "confidence": 0.9, "evidence": "e", "evidence_snippets": x, "evidence_urls": u} for i, (s, x, u, _) in enumerate(cases)])
    out = S.evidence_gate(df).orderBy("id").collect()
    assert [r["signal"] for r in out] == [c[3] for c in cases]
    assert [r["evidence"] for r in out] == ["e", "insufficient_evidence", "insufficient_evidence", "generic_evidence", "e", "generic_evidence", "e"]
    assert [r["confidence"] for r in out] == [0.9, 0.2, 0.2, 0.2, 0.9, 0.2, 0.9]


def test_best_verdict_order(rows):
    df = rows(VERDICT, [{"id": i, "business_id": b, "ord": o, "signal": s, "confidence": c} for i, (b, o, s, c) in enumerate([("a", 1, "no", 0.9), ("a", 2, "unclear", 0.1), ("b", 1, "yes", 0.5), ("b", 2, "yes", 0.7), ("b", 3, "yes", 0.7), ("c", 1, "no", None)])])
    assert {r["business_id"]: r["ord"] for r in S.best_verdict(df).collect()} == {"a": 2, "b": 2, "c": 1}


def test_evidence_downgrade(rows):
    cases = [(["https://a.fi/1"], "maybe", 0.5), (["https://a.fi/1", "https://x.a.fi/2"], "yes", 0.9), (["https://z.fi"], "uncertain", 0.2), (["https://a.fi/1", "https://a.fi/1"], "maybe", 0.5), (["https://a.fi/1", "https://jobs.lever.co/a"], "yes", 0.9)]
    df = rows("id long, domain string, signal string, confidence double, evidence_urls array<string>", [{"id": i, "domain": "a.fi", "signal": "yes", "confidence": 0.9, "evidence_urls": u} for i, (u, _, _) in enumerate(cases)] + [{"id": 9, "domain": "a.fi", "signal": "no", "confidence": 0.6}])
    out = S.evidence_downgrade(df).orderBy("id").collect()
    assert [(r["hiring_status"], r["hiring_confidence"]) for r in out] == [(s, c) for _, s, c in cases] + [("no", 0.6)]
    pairs = rows("s array<string>, u array<string>", [{"s": ["a", "b", ""], "u": ["x"]}, {"s": ["a"], "u": []}])
    got = [[tuple(p) for p in r["p"]] for r in pairs.select(S.evidence_pairs(F.col("s"), F.col("u")).alias("p")).collect()]
    assert got == [[("a", "x"), ("b", "x"), ("", "x")], [("a", "")]]


RULES = "host string, ord int, path_prefix string, allow boolean, site_state string"
RUN = hiring.Run("run", "2024-01-01T00:00:00Z", "Lahti", 1.0)


def scan_inputs(rows):
    companies = rows("business_id string, name string, domain string, website_url string", [{"business_id": b, "name": b, "domain": f"{b}.fi", "website_url": f"https://{b}.fi/home"} for b in ("board", "wall", "shut", "lost", "plain")])
    wall = "<title>Hi</title><p>We use cookies. Accept all. Reject all. Consent.</p>"
    pages = rows(
        "page_id long, url string, html string",
        [
            {"page_id": 1, "url": "https://board.fi/home", "html": "<p>hello</p>"}, {"page_id": 2, "url": "https://board.fi/careers", "html": "<a href='https://jobs.lever.co/board'>Jobs</a>"},
            {"page_id": 3, "url": "https://wall.fi/home", "html": wall}, {"page_id": 4, "url": "https://wall.fi/careers", "html": wall + "<p>gdpr</p>"},
            {"page_id": 5, "url": "https://shut.fi/home", "html": "<p>x</p>"}, {"page_id": 6, "url": "https://plain.fi/home", "html": "<p>hello</p>"},
        ],
    )
    rules = rows(RULES, [{"host": "shut.fi", "ord": 1, "path_prefix": "/", "allow": False, "site_state": "disallow_all"}])
    return companies, pages, rules


def test_hiring_signal_run(rows):
    companies, pages, rules = scan_inputs(rows)
    summary = hiring.scan_summary(hiring.scan(companies, pages, rules, max_urls=2))
    out = {r["business_id"]: r for r in hiring.hiring_signal(companies, summary, RUN).collect()}
    assert {b: (r["signal"], r["evidence"]) for b, r in out.items()} == {"board": ("yes", "ats:lever"), "wall": ("unclear", ""), "shut": ("unclear", ""), "lost": ("unclear", ""), "plain": ("unclear", "")}
    assert out["board"]["signal_url"] == "https://board.fi/careers" and out["board"]["checked_urls"] == "https://board.fi/home;https://board.fi/careers"
    assert (out["shut"]["skipped_reason"], out["lost"]["skipped_reason"], out["plain"]["skipped_reason"]) == ("robots_disallow_all", "fetch_failed", "")
    assert "https://wall.fi/home:cookie_wall:6:1.00:cookie,cookies,we use cookies,accept all,reject all" in out["wall"]["errors"]
    assert contract.signal_violations(hiring.hiring_signal(companies, summary, RUN), "business_id").count() == 0
    wall = {r["business_id"]: r["cookie_wall"] for r in summary.collect()}["wall"]
    assert wall["detected"] and wall["score"] == 1.0 and len(wall["matches"]) == 5


def test_model_answers_fill_open_pages(rows):
    companies, pages, rules = scan_inputs(rows)
    answers = rows(
        "page_id long, signal string, confidence double, evidence string, evidence_snippets array<string>, evidence_urls array<string>",
        [{"page_id": 6, "signal": "yes", "confidence": 0.8, "evidence": "list", "evidence_snippets": ["we are hiring", "apply"], "evidence_urls": ["https://plain.fi/home"]}, {"page_id": 2, "signal": "no", "confidence": 1.0, "evidence": "x", "evidence_snippets": ["not hiring", "no vacancies"], "evidence_urls": ["u"]}],
    )
    summary = {r["business_id"]: r for r in hiring.scan_summary(hiring.scan(companies, pages, rules, answers=answers, max_urls=2)).collect()}
    assert (summary["plain"]["signal"], summary["plain"]["confidence"]) == ("yes", 0.8)
    assert (summary["board"]["signal"], summary["board"]["evidence"]) == ("yes", "ats:lever")


def test_company_packages_and_dossiers(rows):
    maps = "https://www.google.com/maps?place_id="
    requests = rows(
        "run_id string, maps_url string, note string, tags array<string>",
        [
            {"run_id": "bad", "maps_url": "https://evil.example/?place_id=1"}, {"run_id": "noid", "maps_url": "https://www.google.com/maps"}, {"run_id": "fail", "maps_url": maps + "F"},
            {"run_id": "nosite", "maps_url": maps + "N"}, {"run_id": "wall", "maps_url": maps + "W", "note": "call", "tags": ["x", "y"]}, {"run_id": "board", "maps_url": maps + "B"},
        ],
    )
    websites = rows("place_id string, website_url string, lookup_error string", [{"place_id": "F", "lookup_error": "http_500"}, {"place_id": "N"}, {"place_id": "W", "website_url": "https://wall.fi/home"}, {"place_id": "B", "website_url": "https://board.fi/home"}])
    _, pages, rules = scan_inputs(rows)
    resolved = hiring.resolve_requests(requests, websites)
    targets = resolved.where("domain <> ''").select(F.col("run_id").alias("business_id"), "domain", "website_url")
    packages = hiring.company_packages(resolved, hiring.scan_summary(hiring.scan(targets, pages, rules, max_urls=2)), RUN)
    out = {r["run_id"]: r["package"] for r in packages.collect()}
    assert {k: (p["status"], p["degraded_reason"], p["error"]["code"] if p["error"] else None) for k, p in out.items()} == {
        "bad": ("error", "none", "invalid_maps_url"), "noid": ("degraded", "place_id_not_found", "place_id_not_found"), "fail": ("error", "none", "places_lookup_failed"),
        "nosite": ("degraded", "website_missing", "website_missing"), "wall": ("degraded", "cookie_wall", None), "board": ("ok", "none", None),
    }
    assert out["board"]["hiring"]["status"] == "maybe" and out["board"]["hiring"]["confidence"] == 0.5 and len(out["board"]["hiring"]["evidence"]) == 2
    assert out["wall"]["safety"]["cookie_wall"]["detected"] and out["wall"]["safety"]["errors"] == [] and out["wall"]["safety"]["cookie_wall"]["threshold"]["hits_min"] == 2
    assert out["fail"]["safety"]["errors"] == ["places_lookup_failed:http_500"] and out["nosite"]["next_action"]
    as_json = hiring.package_json(packages)
    assert contract.package_violations(as_json).count() == 0
    broken = as_json.withColumn("package", F.replace("package", F.lit('"status":"degraded"'), F.lit('"status":"odd"')))
    assert "invalid status odd" in {r["violation"] for r in contract.package_violations(broken).collect()}
    assert {r["violation"] for r in contract.package_violations(as_json.limit(1).withColumn("package", F.lit("{}"))).collect()} >= {"missing status", "missing hiring"}
    text = {r["run_id"]: r["markdown"] for r in hiring.dossier_markdown(packages).collect()}
    assert text["wall"].startswith("# wall.fi\nDomain: `wall.fi`") and "Cookie wall detected (signals: " in text["wall"] and "- Tags: x, y" in text["wall"]
    assert "Next action: Paste official website URL" in text["nosite"] and text["bad"].startswith("# Unknown company")


def test_contract_violations_for_text_rows(rows):
    columns = ["run_id", "tool_version", "git_sha", "crawl_ts", "station", "max_distance_km", "business_id", "name", "domain", "signal", "confidence", "evidence", "evidence_snippets", "evidence_urls", "signal_url", "checked_urls", "next_url_hint", "errors", "skipped_reason", "ollama_model", "ollama_temperature", "prompt_version", "llm_used", "output_format"]
    good = dict.fromkeys(columns, "") | {"signal": "Yes", "confidence": "0.5", "evidence_snippets": '["a"]', "llm_used": "true", "output_format": "CSV", "max_distance_km": "1"}
    bad = good | {"business_id": "b", "signal": "perhaps", "confidence": "2", "evidence_urls": "[x", "llm_used": "often", "max_distance_km": "far"}
    ddl = ", ".join(f"{c} string" for c in columns)
    assert contract.signal_violations(rows(ddl, [good]), "business_id").count() == 0
    got = {r["violation"] for r in contract.signal_violations(rows(ddl, [bad]), "business_id").collect()}
    assert got == {"invalid signal perhaps", "invalid list column evidence_urls", "invalid llm_used", "confidence out of range", "invalid max_distance_km"}
    short = rows("business_id string, llm_used boolean", [{"business_id": "x", "llm_used": True}])
    assert "missing column signal" in {r["violation"] for r in contract.signal_violations(short, "business_id").collect()}


def test_career_suggestions_prefer_boards_then_paths_then_links(rows):
    companies = rows("business_id string, name string, domain string", [{"business_id": b, "name": b, "domain": f"{b}.fi"} for b in "abcd"])
    links = rows("business_id string, ord int, link string", [{"business_id": "a", "ord": 5, "link": "https://boards.greenhouse.io/a"}, {"business_id": "a", "ord": 1, "link": "https://a.fi/join"}, {"business_id": "c", "ord": 1, "link": "https://c.fi/join"}, {"business_id": "c", "ord": 2, "link": "https://c.fi/x"}])
    signals = rows("url_key string", [{"url_key": k} for k in ("a.fi/careers", "b.fi/rekry", "b.fi/ura", "c.fi/x")])
    out = {r["business_id"]: (r["suggested_base_url"], r["source"], r["confidence"]) for r in P.career_suggestions(companies, links, signals).collect()}
    assert out == {"a": ("https://boards.greenhouse.io/a", "ats", "high"), "b": ("https://b.fi/rekry", "common_path", "med"), "c": ("https://c.fi/x", "homepage_link", "med")}


BROKEN = {
    "unbalanced quote": ('<img alt="19" screen">' + '<a href="/x">l</a>' * 20_000, ("l " * 20_000).strip(), 20_000),
    "many quoted values": ("<p " + " ".join(f'a{i}="v{i}"' for i in range(20_000)) + ">hi</p>", "hi", 0),
    "unquoted apostrophe": ("<p title=it's>hello</p><p>don't</p> tail", "hello don't tail", 0),
    "unclosed script": ("a<script>var x = '<p>';", "a", 0),
    "unclosed comments": ("a" + "<!--" * 50_000, "a", 0),
    "tags without an end": ("a" + "<b " * 50_000, "a" + ("<b " * 50_000).strip(), 0),
    "blanks": ("<p>x" + " " * 100_000 + "y", "x" + " " * 100_000 + "y", 0),
    "references": ("&egrave;&laquo;&#x0001F600;&#55357;&#38;lt;&#0000065;&#150;&#x110000;&#99999999999;&none;&amp;lt;", "è«\U0001f600�&lt;A–��&none;&lt;", 0),
}


def test_broken_pages_keep_their_text(spark):
    names = list(BROKEN)
    df = spark.createDataFrame([(n, BROKEN[n][0]) for n in names], "name string, html string")
    got = {r["name"]: r for r in df.select("name", H.visible_text(F.col("html")).alias("t"), F.size(H.links(F.col("html"))).alias("n")).collect()}
    for n in names:
        assert (got[n]["t"], got[n]["n"]) == BROKEN[n][1:], n


def test_links_of_unclosed_and_odd_anchors(spark):
    page = (
        '<a href="/one">one<a href=/two>Two</a> <a data-href="/no" href="/yes">y</a><a title="a>b" href=\'/q\'>Q</a>'
        "<a class=x HREF = \"/r&amp;s\">R &lt;</a><a name=z>none</a><a href='/last'>tail <b"
    )
    got = spark.createDataFrame([(page,)], "html string").select(H.links(F.col("html")).alias("l")).first()["l"]
    assert [(a["href"], a["text"]) for a in got] == [("/one", "one"), ("/two", "two"), ("/yes", "y"), ("/q", "q"), ("/r&s", "r <"), ("/last", "tail")]
