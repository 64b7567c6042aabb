import random
import statistics

import pytest
from pyspark.sql import functions as F

from hireatlas.operators import analytics as A, crawl, jobs as J, watch as W
from hireatlas.operators.median import grouped_median
from hireatlas.plans import runs

JOB = "ord long, company_business_id string, company_name string, company_domain string, job_title string, job_url string, location_text string, posted_date string, description_snippet string, tags array<string>"
KNOWN = "job_url string, job_fingerprint string"


def job(i, **values):
    return {"ord": i, "company_business_id": "1", "company_domain": "a.fi", "job_title": f"Job {i}", "job_url": f"https://a.fi/{i}", "location_text": "Lahti", "posted_date": "2024-01-01", "tags": ["data"]} | values


def test_first_run_is_new_second_is_not_even_with_a_changed_url(rows):
    jobs = rows(JOB, [job(1), job(2, tags=None)])
    first = J.flag_new(jobs, rows(KNOWN, []))
    assert [r["is_new"] for r in first.collect()] == [True, True]
    state = J.next_state(first)
    moved = rows(JOB, [job(1, job_url="https://a.fi/other", job_title=" JOB  1 ", location_text="Lahti, Finland"), job(2)])
    assert J.new_jobs(moved, state).count() == 0
    assert not any(r["is_new"] for r in J.flag_new(moved, state).collect())


def test_diff_against_itself_is_empty_and_state_options(rows):
    jobs = rows(JOB, [job(i) for i in range(20)])
    current = J.flag_new(jobs, rows(KNOWN, []))
    assert J.new_jobs(jobs, J.next_state(current)).count() == 0
    old = rows(KNOWN, [{"job_url": "gone", "job_fingerprint": "x"}])
    assert J.next_state(current).where("job_url = 'gone'").count() == 0
    assert J.next_state(current, old).where("job_url = 'gone'").count() == 1


def test_dedup_keeps_the_first_by_url_then_by_company_and_fingerprint(rows):
    data = [job(1), job(2, job_url="https://a.fi/1"), job(3, job_title="Job 1"), job(4, job_title="Job 1", company_business_id="2")]
    assert sorted(r["ord"] for r in J.dedup_jobs(rows(JOB, data)).collect()) == [1, 4]
    assert sorted(r["ord"] for r in J.dedup_jobs(rows(JOB, data[::-1]).repartition(4)).collect()) == [1, 4]


def test_null_keys_of_the_state_hide_nothing(rows):
    state = rows(KNOWN, [{"job_url": None, "job_fingerprint": None}])
    assert J.new_jobs(rows(JOB, [job(1)]), state).count() == 1


def test_activity_counts(rows):
    df = rows(JOB, [job(1), job(2, posted_date="2023-01-01", tags=["salesforce", "data"]), job(3, posted_date="soon", tags=None), job(4, company_business_id=None)])
    out = J.company_activity(df.withColumn("is_new", F.col("ord") == 1), F.lit("2024-01-20").cast("timestamp")).collect()
    assert len(out) == 1
    r = out[0]
    assert (r["job_count_total"], r["job_count_last_30d"], r["job_count_new_since_last"], r["recruiting_active"]) == (3, 1, 1, True)
    assert (r["tag_count_data"], r["tag_count_salesforce"], r["tag_count_it_support"]) == (2, 1, 0)
    empty = J.company_activity(rows(JOB, []), F.lit("2024-01-20").cast("timestamp"))
    assert empty.count() == 0 and "tag_count_oppisopimus" in empty.columns


def test_join_with_companies_suffixes_taken_names(rows):
    jobs = rows("company_business_id string, name string", [{"company_business_id": "1", "name": "Job"}, {"company_business_id": "9", "name": "Lost"}])
    companies = rows("business_id string, name string, score double, secret string", [{"business_id": "1", "name": "Comp", "score": 4.0, "secret": "x"}])
    out = {r["company_business_id"]: r.asDict() for r in J.with_company(jobs, companies).collect()}
    assert out["1"] == {"company_business_id": "1", "name": "Job", "name_company": "Comp", "score": 4.0, "business_id": "1"}
    assert out["9"]["score"] is None


@pytest.mark.parametrize("seed", [1, 2])
def test_median_is_exact_with_hot_groups_ties_and_nulls(spark, seed):
    rng = random.Random(seed)
    data = []
    for i in range(6000):
        key = "hot" if i % 3 else f"k{i % 40}"
        a = None if i % 17 == 0 else (float("nan") if i % 19 == 0 else rng.choice([1.5, 1.5, 1.5, rng.uniform(-1e6, 1e6), rng.expovariate(0.001)]))
        data.append((key, a, float(rng.randint(0, 3))))
    data += [("only-null", None, None), ("pair", 1.0, 2.0), ("pair", 2.0, 5.0)]
    df = spark.createDataFrame(data, "k string, a double, b double").repartition(6)
    got = {r["k"]: (r["ma"], r["mb"]) for r in grouped_median(df, ["k"], {"ma": "a", "mb": "b"}).collect()}
    for key in {k for k, _, _ in data}:
        xs = [a for k, a, _ in data if k == key and a is not None and a == a]
        ys = [b for k, _, b in data if k == key and b is not None]
        if xs:
            assert got[key][0] == pytest.approx(statistics.median(xs), rel=1e-12)
            assert got[key][1] == pytest.approx(statistics.median(ys), rel=1e-12)
        else:
            assert key not in got or got[key][0] is None


SHORT = "ord long, business_id string, name string, nearest_station string, industry string, score double, distance_km double, recruiting_active boolean, lat double, lon double, job_count_total long, job_count_new_since_last long, status string, hide_flag boolean, main_business_line string, note string, company_domain string"


def shortlist(rows):
    return rows(
        SHORT,
        [
            {"ord": 1, "business_id": "1", "name": "A", "nearest_station": "Lahti", "industry": "it", "score": 5.0, "distance_km": 1.0, "recruiting_active": True, "lat": 60.0, "lon": 25.0, "job_count_total": 4, "job_count_new_since_last": 2, "note": "n" * 130},
            {"ord": 2, "business_id": "2", "name": "B", "nearest_station": "Lahti", "industry": "it", "score": 3.0, "distance_km": 2.0, "lat": 61.0, "lon": 26.0, "job_count_total": 0, "status": "shortlist"},
            {"ord": 3, "business_id": "3", "name": None, "nearest_station": "Turku", "industry": "other", "score": None, "distance_km": None, "company_domain": "c.fi"},
            {"ord": 4, "business_id": "4", "name": "D", "nearest_station": None, "industry": "it", "score": 9.0},
        ],
    )


def test_summaries(rows):
    s = shortlist(rows)
    new = rows(JOB, [job(1, tags=["data", "it"]), job(2, tags=["data"]), job(3, company_business_id="2", tags=["ml"]), job(4, company_business_id="8", tags=None)])
    stations = [tuple(r) for r in A.station_summary(s, new).collect()]
    assert stations == [("Lahti", 2, 1, 3, 4.0, 1.5), ("Turku", 1, 0, 0, None, None)]
    assert [tuple(r) for r in A.station_summary(s).collect()][0][3] == 0
    industries = [tuple(r) for r in A.industry_summary(s, new).collect()]
    assert industries == [("it", 3, 1, 3, 1.5, "Lahti (2)"), ("other", 1, 0, 0, None, "Turku (1)")]
    tags = [tuple(r) for r in A.tag_summary(new, s).collect()]
    assert tags == [("data", 2, 1, 1.0), ("it", 1, 1, 1.0), ("ml", 1, 1, 2.0)]
    top = A.top_companies(s, new, None, 3).collect()
    assert [(r["business_id"], r["new_jobs_count"], r["top_tags"]) for r in top] == [("1", 2, "data(2);it(1)"), ("2", 1, "ml(1)"), ("4", 0, "")]
    assert [tuple(r) for r in A.jobs_by_tag(new, 2).collect()] == [("data", 2), ("it", 1)]
    assert {r["business_id"]: (r["name"], r["job_count"]) for r in A.jobs_by_company(new, s).collect()} == {"1": ("A", 2), "2": ("B", 1), "8": ("", 1)}


def test_kpi_with_and_without_parts(rows):
    new = rows(JOB, [job(1), job(2)])
    stats = rows("jobs_found long, status string", [{"jobs_found": 2, "status": "ok"}] + [{"jobs_found": 0, "status": s} for s in ("blocked", "blocked", "no_signal", "technical_fail", "consent_gate")])
    full = A.kpi(new, shortlist(rows), stats).collect()
    assert [tuple(r) for r in full] == [(2, 1, 6, 1, "blocked:2;consent_gate:1;no_signal:1")]
    assert [tuple(r) for r in A.kpi(new).collect()] == [(2, None, None, None, None)]


def test_map_bounds_fall_back_to_the_fixed_centre(rows):
    out = A.map_bounds(rows(SHORT, [{"ord": 1, "business_id": "1"}])).first()
    assert (out["median_lat"], out["mean_lon"], out["n_points"], out["min_lat"]) == (60.1699, 24.9384, 0, None)
    out = A.map_bounds(shortlist(rows)).first()
    assert (out["median_lat"], out["max_lon"], out["n_points"]) == (60.5, 26.0, 2)


def test_map_layer(rows):
    new = rows(JOB, [job(i, job_title=f"T{i}", tags=["x"] if i == 1 else []) for i in range(1, 8)])
    out = {r["business_id"]: r for r in W.map_layer(shortlist(rows), new).collect()}
    assert set(out) == {"1", "2"}
    a, b = out["1"], out["2"]
    assert (a["color"], a["radius"], a["layers"], a["status_rgba"]) == ("red", 10.0, "all,recruiting,new_jobs", "0,200,0,180")
    assert (b["color"], b["radius"], b["layers"], b["status_rgba"]) == ("blue", 3.0, "all", "0,150,255,180")
    assert "- T1 [x]" in a["popup"] and "... +2 more" in a["popup"] and "T6" not in a["popup"] and "n" * 117 + "..." in a["popup"]
    assert "New jobs: 0" in b["popup"]


def test_classifier_metrics(rows):
    df = rows("predicted string, label string", [{"predicted": p, "label": t} for p, t in [("yes", "yes"), ("unclear", "yes"), ("yes", "yes"), ("unclear", "yes"), ("unclear", "no"), ("unclear", "unclear")]])
    r = A.classifier_metrics(df).first()
    assert [round(r[c], 2) for c in ("accuracy", "precision", "recall", "uncertain_rate")] == [0.5, 1.0, 0.5, 0.67]
    assert A.within_thresholds(A.classifier_metrics(df), min_precision=0.9, max_uncertain=0.7).first()["passed"] is True
    none = A.classifier_metrics(df.limit(0)).first()
    assert (none["total"], none["precision"], none["uncertain_rate"]) == (0, 0.0, 0.0)


def test_watch_order_unknown_values_pass_and_labels(rows):
    jobs = rows(
        JOB,
        [
            job(1, company_business_id="2", tags=["ml"]), job(2, company_business_id="1", tags=["Data"]), job(3, company_business_id="9", tags=["data"], company_domain="nine.fi"),
            job(4, company_business_id="2", tags=["data"], job_title="Senior lead"), job(5, company_business_id="3", tags=["data"]),
        ],
    )
    watched = W.watch_jobs(jobs, shortlist(rows), include_tags=["data"], exclude_keywords=["LEAD"], min_score=4, max_distance_km=5.0)
    assert [r["ord"] for r in W.watch_list(watched).collect()] == [2, 3, 5]
    labels = {r["ord"]: r["company_label"] for r in watched.collect()}
    assert labels == {2: "A", 3: "nine.fi", 5: "a.fi"}
    everything = W.watch_jobs(jobs, shortlist(rows))
    assert [r["ord"] for r in W.watch_list(everything, 2).collect()] == [2, 1]
    assert W.watch_jobs(jobs, shortlist(rows), restrict_to_view=True).count() == 4
    assert W.watch_jobs(jobs, shortlist(rows), stations=["turku"]).count() == 2
    assert {(r["company_business_id"], r["n_jobs"], r["name"]) for r in W.watch_company_counts(everything).collect()} == {("2", 2, "B"), ("1", 1, "A"), ("9", 1, ""), ("3", 1, "")}
    assert tuple(W.watch_totals(jobs, watched).first()) == (5, 3)
    block = W.watch_lines(watched, 1).first()["block"]
    assert block.split("\n") == ["- A (1): Job 2", "  tags: Data", "  location: Lahti", "  score=5.0, distance_km=1.0, station=Lahti", "  link: https://a.fi/2"]


LOG = "domain string, seq long, url string, final_url string, status_code int, n_bytes long, error string, jobs long, skipped_reason string, extractor string"


def event(domain, seq, **values):
    return {"domain": domain, "seq": seq, "url": f"https://{domain}/{seq}", "final_url": f"https://{domain}/{seq}", "status_code": 200, "n_bytes": 10, "jobs": 0} | values


def test_crawl_stats_and_status(rows):
    log = [
        event("ok.fi", 1, jobs=2, extractor="jsonld"), event("ok.fi", 2, error="listing_url_skipped"),
        event("robots.fi", 1, error="robots_disallow_url"), event("robots.fi", 2, error="robots_disallow_all"), event("robots.fi", 3, skipped_reason="robots_disallow_all"),
        event("http.fi", 1, error="http_403"), event("cookie.fi", 1, error="cookie_consent"), event("cookie.fi", 2, error="cookie_consent"), event("cookie.fi", 3, error="timeout"),
        event("dns.fi", 1, skipped_reason="dns", status_code=None), event("quiet.fi", 1), event("", 1, status_code=None),
    ]
    out = {r["domain"]: r for r in crawl.crawl_stats(rows(LOG, log).repartition(3)).collect()}
    assert {d: r["status"] for d, r in out.items()} == {"ok.fi": "ok", "robots.fi": "blocked", "http.fi": "blocked", "cookie.fi": "consent_gate", "dns.fi": "technical_fail", "quiet.fi": "no_signal", "": "no_domain"}
    assert out["cookie.fi"]["errors_top"] == "cookie_consent:2;timeout:1" and out["cookie.fi"]["errors_count"] == 3
    assert out["robots.fi"]["first_blocked_url"] == "https://robots.fi/1" and out["robots.fi"]["robots_rule_hit"] == "robots_disallow_url"
    assert (out["ok.fi"]["jobs_found"], out["ok.fi"]["pages_fetched"], out["ok.fi"]["extractor_used"]) == (2, 1, "jsonld")
    half = crawl.crawl_counters(rows(LOG, log[::2])), crawl.crawl_counters(rows(LOG, log[1::2]))
    merged = {r["domain"]: r for r in crawl.stats_from_counters(crawl.merge_counters(*half)).collect()}
    assert merged == out
    coverage = W.crawl_coverage(crawl.crawl_stats(rows(LOG, log))).first()
    assert (coverage["domains_total"], coverage["domains_with_jobs"]) == (7, 1)
    assert coverage["status_breakdown"].startswith("blocked=2, ") and coverage["top_skip_reasons"] == "blocked: 2, consent_gate: 1, no_domain: 1"


def test_fetch_outcomes(rows):
    log = [event("a", 1), event("a", 2, status_code=429), event("a", 3, status_code=503), event("a", 4, status_code=404), event("a", 5, n_bytes=3_000_000), event("a", 6, status_code=None), event("a", 7, final_url="https://b/"), event("a", 8, final_url="https://a/8/")]
    got = [(r["outcome"], r["retryable"], r["redirected"]) for r in crawl.fetch_outcome(rows(LOG, log)).orderBy("seq").collect()]
    assert got == [("ok", False, False), ("http_429", True, False), ("http_503", True, False), ("http_404", False, False), ("response_too_large", False, False), ("max_retries_exceeded", False, False), ("ok", False, True), ("ok", False, False)]


RULES = "host string, ord int, path_prefix string, allow boolean, site_state string"


def test_access_gate(rows):
    rules = rows(
        RULES,
        [
            {"host": "a.fi", "ord": 1, "path_prefix": "/jobs/open", "allow": True}, {"host": "a.fi", "ord": 2, "path_prefix": "/jobs", "allow": False}, {"host": "a.fi", "ord": 3, "path_prefix": "", "allow": False},
            {"host": "down.fi", "ord": 1, "path_prefix": "", "allow": False, "site_state": "unreachable"}, {"host": "shut.fi", "ord": 1, "path_prefix": "/", "allow": False, "site_state": "disallow_all"},
            {"host": "all.fi", "ord": 1, "path_prefix": "/", "allow": False},
        ],
    )
    urls = ["https://a.fi/jobs/open/1", "https://a.fi/jobs/2", "https://a.fi/x", "https://down.fi/", "https://shut.fi", "https://all.fi", "https://none.fi/jobs"]
    df = rows("id long, url string", [{"id": i, "url": u} for i, u in enumerate(urls)])
    got = [r["skip_reason"] for r in crawl.access_gate(df, rules).orderBy("id").collect()]
    assert got == ["", "robots_disallow_url", "", "robots_unavailable", "robots_disallow_all", "robots_disallow_url", ""]
    assert all(r["allowed"] for r in crawl.access_gate(df.where("id IN (1, 3)"), rules, ["a.fi", "DOWN.fi"]).collect())


def test_candidates_budget_and_seeds(rows):
    companies = rows("business_id string, domain string, website_url string", [{"business_id": "1", "domain": "a.fi", "website_url": "a.fi/en"}, {"business_id": "2", "domain": "b.fi", "website_url": "nan"}])
    pages = rows("page_id long, url string, html string", [{"page_id": 1, "url": "http://A.fi/careers/", "html": ""}, {"page_id": 2, "url": "https://a.fi/careers#x", "html": ""}, {"page_id": 3, "url": "https://b.fi", "html": ""}, {"page_id": 4, "url": "https://b.fi/z", "html": ""}])
    got = {}
    for r in crawl.site_candidates(companies, pages, limit=3).collect():
        got.setdefault(r["business_id"], []).append((r["ord"], r["url"], r["page_id"]))
    assert sorted(got["1"]) == [(0, "https://a.fi/en", None), (1, "https://a.fi/careers", 1), (2, "https://a.fi", None)]
    assert sorted(got["2"]) == [(0, "https://b.fi/careers", None), (1, "https://b.fi", 3), (2, "https://b.fi/jobs", None)]
    assert sorted(r["page_id"] for r in crawl.page_budget(pages, 1, "page_id").collect()) == [1, 2, 3]
    assert sorted(r["page_id"] for r in crawl.page_budget(pages, 5, "page_id", domains=1).collect()) == [1]
    seeds = companies.select(crawl.seed_urls(F.col("domain"), F.array(F.lit("https://a.fi/jobs"))).alias("s")).first()["s"]
    assert seeds[:3] == ["https://a.fi/jobs", "https://a.fi/careers", "https://a.fi/rekry"] and len(seeds) == 8


def test_jobs_run_counts_activity_after_the_comparison(rows, folder, spark):
    jobs, known = rows(JOB, [job(1), job(2)]), rows(KNOWN, [{"job_url": "https://a.fi/1", "job_fingerprint": "-"}])
    run = runs.jobs_run(jobs, known, F.lit("2024-01-10").cast("timestamp"))
    assert run["activity"].first()["job_count_new_since_last"] == 1
    base = folder("run")
    runs.publish_jobs_run(run, base, "20240110")
    assert spark.read.parquet(f"{base}/Jobs_New").count() == 1
    assert {r["job_url"] for r in spark.read.parquet(f"{base}/known_jobs/version=1").collect()} == {"https://a.fi/1", "https://a.fi/2"}
    bundle = runs.analytics_bundle(shortlist(rows), run["jobs_new"], run["jobs_all"], None)
    assert set(bundle) == {"KPI", "Stations", "Tags_New", "Tags_All", "Top_Companies", "Industry_Summary"}
    assert bundle["Tags_All"].first()["new_jobs"] == 2
