"""Registered queries: every operator run over the bound test tables, whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hireatlas import rules, schemas
from hireatlas.functions import urls as U, values as V
from hireatlas.functions.geo import haversine_km
from hireatlas.functions.keywords import keyword_places, rule_words, snippets_at, tags_at
from hireatlas.functions.text import detect_tags, fold_nordic, ordered_tags, pick_first, sorted_tags, to_ascii
from hireatlas.operators import (
    analytics as A, companies as C, contract, crawl, extraction as X, filters as L, industry as I, jobs as J, nearby,
    overlay as O, pages as P, signal as S, watch as W,
)
from hireatlas.operators.once import compute_once, spread
from hireatlas.plans import hiring, runs
from hireatlas.plans.bindings import SITE_PATHS, TAG_RULES, VOCABULARY, bound, table
from hireatlas.session import configure, materialize
from hireatlas.sources import readers, writers
from hireatlas.sources.lines import bad_line_counts, split_lines
from hireatlas.sources.readers import latest_rows, snapshot_date
from hireatlas.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = "2001-08-02 00:00:00"
CUT = "2000-06-01"
CRAWL_TS = "2024-01-01T00:00:00Z"
RUN = hiring.Run("run1", CRAWL_TS, "NATION_3", 25.0, model_used=True, model="m1")
SPEC = L.FilterSpec(
    cities=["mantsala", "Lahti", "Jyvaskyla"], min_score=1, max_distance_km=60.0, include_tags=["Data", "ai", "junior"],
    exclude_tags=["salesforce"], search="customer#",
)
WATCH = dict(include_tags=["data", "it_support", "oppisopimus"], exclude_keywords=["order o"], min_score=2, max_distance_km=70.0)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def r6(c: str | Column) -> Column:
    return F.round(c, 6)


def joined(c: str | Column) -> Column:
    return F.array_join(c, "|")


# --- inputs built by the operators themselves -------------------------------------------------


def stations(spark, d):
    return bound(spark, d, "stations")


def companies(spark, d):
    df = bound(spark, d, "companies")
    return df.withColumn("industry", I.classify(F.col("main_business_line"), rules.INDUSTRY_GROUPS))


def shortlist(spark, d):
    return nearby.nearest_station(companies(spark, d), stations(spark, d))


def overlay(spark, d):
    return bound(spark, d, "overlay").where("listed").drop("listed")


def view(spark, d):
    return O.apply_overlay(shortlist(spark, d), overlay(spark, d))


def jobs_raw(spark, d):
    df = bound(spark, d, "jobs_raw")
    return df.withColumn("tags", detect_tags(F.concat_ws(" ", "job_title", "description_snippet"), TAG_RULES))


def known(spark, d):
    old = jobs_raw(spark, d).where(F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz"))
    return old.withColumn("job_fingerprint", J.fingerprint()).select("job_url", "job_fingerprint")


def flagged(spark, d):
    return J.flag_new(jobs_raw(spark, d), known(spark, d))


def new_jobs(spark, d):
    return J.new_jobs(jobs_raw(spark, d), known(spark, d))


def activity(spark, d):
    return J.company_activity(flagged(spark, d), F.lit(AS_OF).cast("timestamp"), rules.ACTIVITY_TAGS, 900)


def fetch_log(spark, d):
    return bound(spark, d, "fetch_log")


def stats(spark, d):
    return crawl.crawl_stats(fetch_log(spark, d))


def site_pages(spark, d):
    return bound(spark, d, "site_pages")


def page_keys(spark, d):
    """Number and address of every page, stored, for inputs that several parts of a query derive from them."""
    return materialize(site_pages(spark, d).select("page_id", "url"), "site-keys")


def site_companies(spark, d, pages=None):
    """One company per host, with its first page as website."""
    host = U.authority(F.col("url"))
    return (
        (pages or site_pages(spark, d))
        .groupBy(host.alias("domain"))
        .agg(F.min("page_id").alias("ord"), F.min_by("url", "page_id").alias("website_url"))
        .select(F.concat(F.lit("H-"), "domain").alias("business_id"), F.concat(F.lit("Site "), "domain").alias("name"), "domain", "website_url", "ord")
    )


def access_rules(spark, d, pages=None):
    """Rules per host out of the page table: a few closed paths, a blocked site, an unreachable one."""
    p = (pages or site_pages(spark, d)).select("page_id", U.authority(F.col("url")).alias("host"), U.path_of(F.col("url")).alias("path"))
    some = p.where("page_id % 5 = 0").select(
        "host", F.col("page_id").cast("int").alias("ord"), F.substring("path", 1, 5).alias("path_prefix"), (F.col("page_id") % 3 == 0).alias("allow")
    )
    hosts = p.groupBy("host").agg(F.min("page_id").alias("first"))
    state = F.when(F.col("first") % 7 == 3, F.lit("disallow_all")).when(F.col("first") % 7 == 5, F.lit("unreachable"))
    open_rule = hosts.select("host", F.lit(1000000).alias("ord"), F.lit("").alias("path_prefix"), F.lit(False).alias("allow"), state.alias("site_state"))
    return some.withColumn("site_state", F.lit(None).cast("string")).unionByName(open_rule)


def answers(spark, d):
    df = bound(spark, d, "model_answers")
    return compute_once(df, {"v": S.parse_answer(F.col("answer"))}).where("v IS NOT NULL").select("answer_id", "business_key", "turn", "v.*")


# --- projections and scalars ------------------------------------------------------------------


@query
def pick_first_query(spark, d):
    df = companies(spark, d)
    return df.select("business_id", pick_first("website_url", "_source_city", "note", "name").alias("value"))


@query
def clean_address(spark, d):
    df = bound(spark, d, "registry")
    return df.select("business_id", C.clean_address(F.col("street1"), F.col("post1"), F.col("city0")).alias("address"))


def _registry(spark, d):
    df = bound(spark, d, "registry")

    def name(i: int) -> Column:
        return F.struct(
            F.col(f"name{i}").alias("name"), F.col(f"type{i}").alias("type"), F.col(f"reg{i}").alias("registrationDate"), F.col(f"end{i}").alias("endDate")
        )

    def address(i: int) -> Column:
        return F.struct(F.col(f"street{i}").alias("street"), F.col(f"post{i}").alias("postCode"), F.col(f"city{i}").alias("city"))

    return df.select(
        "ord",
        F.col("business_id").alias("businessId"),
        F.col("plain_name").alias("name"),
        F.array(name(0), name(1), name(2)).alias("names"),
        F.array(address(0), address(1)).alias("addresses"),
        "_source_city",
        "domicile",
    )


@query
def address_pick(spark, d):
    df = _registry(spark, d)
    return df.select("businessId", C.picked_address(F.col("addresses"), F.col("_source_city")).alias("a")).select(
        F.col("businessId").alias("business_id"), "a.street", F.col("a.postCode").alias("post_code"), "a.city"
    )


@query
def official_name(spark, d):
    return _registry(spark, d).select(F.col("businessId").alias("business_id"), C.official_name(F.col("names")).alias("name"))


@query
def normalize_registry(spark, d):
    out = C.normalize_registry(_registry(spark, d))
    return out.select("business_id", "name", "street", "post_code", "city", "full_address", "industry")


@query
def parse_address(spark, d):
    df = bound(spark, d, "places")
    return df.select("ord", C.parse_address(F.col("formatted_address")).alias("a")).select("ord", "a.*")


@query
def clean_domain(spark, d):
    return companies(spark, d).select("business_id", U.clean_domain("website_url").alias("domain"))


@query
def domain_template(spark, d):
    return companies(spark, d).select("business_id", C.company_domain("domain", "website_url").alias("domain"))


@query
def url_party(spark, d):
    p = site_pages(spark, d)
    domain = F.regexp_replace(U.authority(F.col("url")), r"^[^.]*\.", "")
    pick = F.when(F.col("page_id") % 3 == 0, U.authority(F.col("url"))).when(F.col("page_id") % 3 == 1, domain).otherwise(F.lit("thre.example.com"))
    ats = F.concat(F.lit("https://c"), F.col("page_id").cast("string"), F.lit(".lever.co/x"))
    link = F.when(F.col("page_id") % 5 == 0, ats).otherwise(F.col("url"))
    return p.select("page_id", pick.alias("domain"), link.alias("link")).select(
        "page_id", U.is_first_party(F.col("link"), F.col("domain")).alias("first_party"), U.is_ats_host(F.col("link")).alias("ats_host")
    )


def maps_links(spark, d, pages=None):
    n = F.col("page_id").cast("string")
    link = (
        F.when(F.col("page_id") % 6 == 0, F.concat(F.lit("https://www.google.com/maps?place_id=PL"), n, F.lit("&x=1")))
        .when(F.col("page_id") % 6 == 1, F.concat(F.lit("https://maps.google.com/?q=a&query_place_id=Q%3A"), n))
        .when(F.col("page_id") % 6 == 2, F.concat(F.lit("https://www.google.com/maps/place/x/data=!4m5!1s0x"), n, F.lit("%3A0x1!8m2")))
        .when(F.col("page_id") % 6 == 3, F.concat(F.lit("https://maps.example.com/?place_id=PL"), n))
        .when(F.col("page_id") % 6 == 4, F.lit("https://goo.gl/maps/abc"))
        .otherwise(F.concat(F.lit(" https://google.com/maps?placeid=W"), n, F.lit("&place_id= ")))
    )
    return (pages or site_pages(spark, d)).withColumn("maps_url", link)


@query
def place_id_extract(spark, d):
    return maps_links(spark, d).select("page_id", U.place_id("maps_url").alias("place_id"))


@query
def fold_city(spark, d):
    df = companies(spark, d)
    return df.select("business_id", fold_nordic("city").alias("folded"), to_ascii(F.col("city")).alias("ascii"))


@query
def normalize_tags(spark, d):
    df = companies(spark, d)
    return df.select("business_id", joined(ordered_tags("tags")).alias("ordered"), joined(sorted_tags("tags")).alias("sorted"))


@query
def detect_tags_query(spark, d):
    tag_rules = {"that": ["that", "thth"], "sch": ["sch", "nicht"], "que": [" que "], "data": ["data"]}
    df = spread(table(spark, d, "documents").select("doc_id", "text"))
    df = compute_once(df.select("doc_id", keyword_places(F.lower("text"), rule_words(tag_rules)).alias("words")), {"found": tags_at(F.col("words"), tag_rules)})
    return df.select("doc_id", joined("found").alias("tags"))


@query
def haversine(spark, d):
    df = companies(spark, d)
    km = haversine_km(F.col("lat"), F.col("lon"), F.lit(60.1699), F.lit(24.9384))
    return df.select("business_id", r6(km).alias("km"))


@query
def job_fingerprint(spark, d):
    return jobs_raw(spark, d).select("ord", J.fingerprint().alias("fingerprint"))


@query
def snippets_query(spark, d):
    df = compute_once(spread(table(spark, d, "documents").select("doc_id", "text")), {"words": keyword_places(F.lower("text"), VOCABULARY.evidence)})
    return df.select("doc_id", joined(snippets_at(F.col("text"), F.col("words"), VOCABULARY.evidence, 4)).alias("snippets"))


@query
def posted_ts(spark, d):
    return jobs_raw(spark, d).select("ord", F.date_format(V.posted_ts("posted_date"), "yyyy-MM-dd HH:mm:ss").alias("posted"))


@query
def json_repair(spark, d):
    df = bound(spark, d, "model_answers").withColumn("j", V.embedded_json("answer"))
    return df.select(
        "answer_id",
        V.json_text(F.col("j"), "$.hiring_signal").alias("hiring_signal"),
        F.try_variant_get("j", "$.confidence", "double").alias("confidence"),
        V.json_text(F.col("j"), "$.evidence_snippets[0]").alias("first_snippet"),
    )


@query
def evidence_pairs(spark, d):
    pairs = S.evidence_pairs(F.col("evidence_snippets"), F.col("evidence_urls"))
    text = F.transform(pairs, lambda p: F.concat(p["snippet"], F.lit(" @ "), p["url"]))
    return answers(spark, d).select("answer_id", joined(text).alias("evidence"))


@query
def coerce_values(spark, d):
    df = companies(spark, d)
    word = F.when(F.col("ord") % 5 == 0, F.lit(" Yes ")).when(F.col("ord") % 5 == 1, F.lit("f")).when(F.col("ord") % 5 == 2, F.lit("maybe")).otherwise(F.col("recruiting_active").cast("string"))
    number = F.when(F.col("ord") % 3 == 0, F.lit("12.5 ")).when(F.col("ord") % 3 == 1, F.lit("x")).otherwise(F.col("score").cast("string"))
    listed = F.when(F.col("ord") % 4 == 0, F.lit('["a","b"]')).when(F.col("ord") % 4 == 1, F.lit("[broken")).otherwise(F.col("tags"))
    return df.select("business_id", word.alias("w"), number.alias("n"), listed.alias("l")).select(
        "business_id", V.parse_bool("w").alias("flag"), V.parse_number("n").alias("number"), joined(V.parse_list("l")).alias("items")
    )


# --- companies --------------------------------------------------------------------------------


@query
def nearest_station(spark, d):
    return shortlist(spark, d).select("business_id", "nearest_station", r6("distance_km").alias("distance_km"))


@query
def nearest_station_cells(spark, d):
    """The same join by growing cells, the way a long station list is handled."""
    out = nearby.nearest_station(companies(spark, d), stations(spark, d), compiled=False)
    return out.select("business_id", "nearest_station", r6("distance_km").alias("distance_km"))


@query
def radius_join(spark, d):
    out = nearby.radius_join(companies(spark, d), stations(spark, d), 30.0)
    return out.select("business_id", "station_name", r6("distance_km").alias("distance_km"))


@query
def nearby_report(spark, d):
    return A.nearby_report(shortlist(spark, d), 25.0).select("business_id", "name", "nearest_station", r6("distance_km").alias("distance_km"))


@query
def industry_classify(spark, d):
    return companies(spark, d).select("business_id", "industry")


@query
def industry_classify_table(spark, d):
    """The same classification with the rules as a table."""
    df = bound(spark, d, "companies")
    rows = [(g, i, p) for i, (g, prefixes) in enumerate(rules.INDUSTRY_GROUPS.items()) for p in prefixes]
    prefixes = spark.createDataFrame(rows, "group string, ord int, prefix string")
    return I.classify_by_table(df, "main_business_line", prefixes).select("business_id", "industry")


@query
def places_master(spark, d):
    s = stations(spark, d).select(F.col("ord").alias("station_key"), "station_name", F.col("lat").alias("station_lat"), F.col("lon").alias("station_lon"))
    rows = C.place_rows(bound(spark, d, "places").join(s, "station_key"))
    out = C.closest_station_row(rows)
    return out.select("business_id", "name", "full_address", "street", "post_code", "city", "nearest_station", r6("distance_km").alias("distance_km"), "website_url", "status", "industry", "source")


@query
def housing_filter(spark, d):
    return companies(spark, d).where(C.is_housing_name(F.col("name"))).select("business_id", "name")


@query
def exclude_reason(spark, d):
    df = companies(spark, d)
    form = F.upper(F.coalesce(C.filled("company_form"), F.lit("")))
    return df.select("business_id", C.exclude_reason(form, F.col("name")).alias("reason"))


@query
def industry_gate(spark, d):
    df = companies(spark, d)
    return df.select("business_id", C.industry_gate(F.col("main_business_line"), ["62", "1"], ["47", "5."]).alias("g")).select(
        "business_id", F.col("g.pass").alias("passes"), "g.reason", "g.hard"
    )


@query
def industry_filter(spark, d):
    return C.industry_filter(companies(spark, d), "main_business_line", ["62", "1"], ["47", "5."]).select("business_id", "main_business_line")


@query
def shortlist_and_excluded(spark, d):
    df = companies(spark, d).withColumn("company_form", F.upper(F.coalesce(C.filled("company_form"), F.lit(""))))
    kept, excluded = C.split_excluded(df)
    return kept.unionByName(excluded).select("business_id", "excluded_reason")


@query
def transliterate(spark, d):
    n = F.col("c_custkey").cast("string")
    k = F.col("c_custkey") % 8
    words = F.when(k == 0, "Θεσσαλονίκη ").when(k == 1, "Щёлково ").when(k == 2, "Київ ").when(k == 3, "Ｆｕｌｌ ").when(k == 4, "ﬁn €").when(k == 5, "Łódź – ").when(k == 6, "東京 ").otherwise("plain ")
    return table(spark, d, "customer").select("c_custkey", to_ascii(F.concat(words, n)).alias("ascii"))


@query
def dedup_companies(spark, d):
    df = companies(spark, d)
    offset = 10_000_000_000
    copies = df.where("ord % 5 = 0").withColumns({"ord": F.col("ord") + offset, "lat": F.col("lat") + 0.5, "name": F.concat(F.lit("copy "), "name")})
    blanks = df.where("ord % 7 = 0").withColumns({"ord": F.col("ord") + 2 * offset, "business_id": F.lit(" ")})
    missing = df.withColumn("lat", F.when(F.col("ord") % 2 == 1, F.col("lat")))
    return C.deduplicate(missing.unionByName(copies).unionByName(blanks)).select("business_id", "ord", "name", r6("lat").alias("lat"))


@query
def union_dedup(spark, d):
    p = bound(spark, d, "places").withColumn("place_id", F.nullif(F.col("place_id"), F.lit("")))
    batches = [p.where(F.col("station_key") % 3 == i) for i in (2, 0, 1)]
    return C.union_distinct(batches, "place_id").select("place_id", "ord", "station_key")


@query
def domain_ladder(spark, d):
    df = companies(spark, d)
    mapped = df.where("ord % 2 = 0").select("business_id", F.concat(F.lit("map"), F.col("ord").cast("string"), F.lit(".example")).alias("domain"))
    suggested = df.where("ord % 3 = 0").select("business_id", F.concat(F.lit("sug"), F.col("ord").cast("string"), F.lit(".example")).alias("domain"))
    again = df.where("ord % 4 = 0").select("business_id", F.concat(F.lit("alt"), F.col("ord").cast("string"), F.lit(".example")).alias("domain"), F.lit(1).alias("ord"))
    mapped = mapped.withColumn("ord", F.lit(0)).unionByName(again)
    return C.domain_ladder(df, mapped, suggested).select("business_id", "domain")


@query
def domain_fill(spark, d):
    df = companies(spark, d)
    return C.fill_domains(df.select("business_id", "domain"), df.select("business_id", "website_url", "ord")).select("business_id", "domain")


@query
def missing_website(spark, d):
    return C.missing_website(companies(spark, d)).select("business_id", "website_url")


@query
def geocode_cache_hit(spark, d):
    df = companies(spark, d).withColumn("full_address", F.concat_ws(", ", "note", "city")).drop("lat", "lon")
    return runs.geocode_hits(df, _cache(spark, d)).select("business_id", r6("lat").alias("lat"), r6("lon").alias("lon"), "provider")


def _cache(spark, d):
    df = companies(spark, d).where("ord % 3 <> 1")
    return df.select(F.concat_ws(", ", "note", "city").alias("address"), F.col("ord").cast("double").alias("lat"), (F.col("ord") * 2).cast("double").alias("lon"), F.lpad(F.col("ord").cast("string"), 9, "0").alias("ts"))


@query
def geocode_cache_miss(spark, d):
    df = companies(spark, d).withColumn("full_address", F.concat_ws(", ", "note", "city"))
    return runs.geocode_misses(df, _cache(spark, d))


@query
def geocode_cache_merge(spark, d):
    cache = _cache(spark, d)
    fresh = companies(spark, d).where("ord % 4 = 1").select(
        F.concat_ws(", ", "note", "city").alias("address"), "lat", "lon", F.lpad((F.col("ord") + 7).cast("string"), 9, "0").alias("ts")
    )
    return runs.cache_merge(cache, fresh).select("address", r6("lat").alias("lat"), r6("lon").alias("lon"), "ts")


@query
def employee_join(spark, d):
    df = companies(spark, d)
    extra = df.where("ord % 4 = 0").select("business_id", (F.col("ord") % 100).cast("int").alias("employee_count"), F.lit("1-99").alias("employee_band"), F.lit(0).alias("ord"))
    later = df.where("ord % 8 = 0").select("business_id", ((F.col("ord") + 7) % 50).cast("int").alias("employee_count"), F.lit("0-49").alias("employee_band"), F.lit(1).alias("ord"))
    extra = extra.unionByName(later)
    return C.with_employees(df, extra).select("business_id", "employee_count", "employee_band")


@query
def company_score(spark, d):
    out = C.score_companies(shortlist(spark, d), activity(spark, d), radius_km=15.0, allow=["62", "1"], deny=["47", "5."])
    return out.select("business_id", F.col("score").cast("long").alias("score"), "score_reasons")


# --- filters and overlay ----------------------------------------------------------------------


@query
def effective_view(spark, d):
    return view(spark, d).select("business_id", "status", "hide_flag", "note", "industry_effective", joined("tags_effective").alias("tags"))


@query
def effective_filter(spark, d):
    return L.apply_filter(view(spark, d), SPEC).select("business_id", "name", "nearest_station")


@query
def explain_filter(spark, d):
    out = L.explain_filter(view(spark, d), SPEC)
    return out.select("business_id", "passes", joined("reasons").alias("reasons"), joined("fails").alias("fails"))


@query
def effective_view_meta(spark, d):
    out = O.view_meta(shortlist(spark, d), overlay(spark, d), SPEC, "20240101", "20240102")
    return out.select("rows_master", "rows_curation", "rows_filtered", "date_master", "date_diff", "mismatch")


@query
def preset_counts(spark, d):
    return L.preset_counts(view(spark, d))


@query
def map_filter(spark, d):
    out = L.map_filter(shortlist(spark, d), industries=["IT", "manufacturing"], code_prefixes=["6", "1", "2"], only_recruiting=True, min_score=3, max_distance_km=40.0)
    return out.select("business_id")


@query
def scan_targets(spark, d):
    return L.scan_targets(shortlist(spark, d), station="nation_3", max_distance_km=40.0).select("business_id", "domain")


@query
def retention_split(spark, d):
    return L.retention_counts(table(spark, d, "events"), "ts", F.lit("2024-01-31").cast("timestamp_ntz"), 15, ["event_type"])


@query
def filter_values(spark, d):
    return L.filter_values(view(spark, d))


@query
def prev_next(spark, d):
    view_ = shortlist(spark, d).select("business_id", "score", "name")
    return L.neighbours(view_, [F.col("score").desc_nulls_last(), F.col("name").asc()], "business_id")


@query
def company_jobs_semi(spark, d):
    return L.jobs_of_view(jobs_raw(spark, d), companies(spark, d).where("recruiting_active")).select("ord", "company_business_id")


@query
def key_violations(spark, d):
    df = jobs_raw(spark, d).withColumn("business_id", F.when(F.col("ord") % 97 == 0, F.lit(" ")).otherwise(F.col("company_business_id")))
    return C.key_violations(df)


def edits(spark, d, name):
    return bound(spark, d, name).where("listed").drop("listed")


@query
def overlay_upsert(spark, d):
    return _after(spark, d)


@query
def merge_edits(spark, d):
    a = edits(spark, d, "edits_a").withColumn("present", F.array([F.lit(f) for f in O.FIELDS]))
    b = edits(spark, d, "edits_b").withColumn("present", F.array([F.lit(f) for f in ("status", "note", "tags_add")]))
    return O.merge_edits([a, b]).withColumn("present", joined("present"))


def _after(spark, d):
    """Two batches of edits in one go: ids that both edit have the later one."""
    both = edits(spark, d, "edits_a").withColumn("seq", F.lit(1)).unionByName(edits(spark, d, "edits_b").withColumn("seq", F.lit(2)))
    return O.upsert(overlay(spark, d), both, source_master="m2", updated_by="me")


@query
def edit_diff(spark, d):
    return O.edit_diff(overlay(spark, d), _after(spark, d))


@query
def edit_diff_rows(spark, d):
    return O.edit_diff_rows(overlay(spark, d), _after(spark, d)).select("business_id", joined("changed_fields").alias("changed_fields"))


@query
def edit_examples(spark, d):
    """The first five changed rows of a diff, as a report shows them."""
    return O.edit_examples(overlay(spark, d), _after(spark, d)).select("business_id", joined("changed_fields").alias("changed_fields"))


# --- jobs -------------------------------------------------------------------------------------


@query
def dedup_jobs(spark, d):
    return J.dedup_jobs(jobs_raw(spark, d)).select("ord", "company_business_id", "job_url", "job_fingerprint")


@query
def jobs_diff(spark, d):
    return new_jobs(spark, d).select("ord", "company_business_id", "job_title", "job_url")


@query
def jobs_diff_flagged(spark, d):
    return flagged(spark, d).select("ord", "job_url", "is_new")


@query
def company_activity(spark, d):
    return activity(spark, d)


@query
def jobs_with_company(spark, d):
    out = J.with_company(new_jobs(spark, d), view(spark, d))
    return out.select("ord", "company_business_id", "name", "nearest_station", r6("distance_km").alias("distance_km"), "score", "industry_effective", "status")


@query
def jobs_per_company(spark, d):
    return A.jobs_per_company(jobs_raw(spark, d))


@query
def watch_list(spark, d):
    out = W.watch_list(W.watch_jobs(new_jobs(spark, d), shortlist(spark, d), **WATCH), 200)
    return out.select("ord", "company_business_id", "company_label", "job_title", "tag_hit", "score", r6("distance_km").alias("distance_km"), "nearest_station")


@query
def watch_company_counts(spark, d):
    return W.watch_company_counts(W.watch_jobs(new_jobs(spark, d), shortlist(spark, d), **WATCH))


@query
def watch_lines(spark, d):
    watched = W.watch_jobs(new_jobs(spark, d), shortlist(spark, d).withColumn("distance_km", F.lit(None).cast("double")), **WATCH)
    return W.watch_lines(watched)


# --- summaries --------------------------------------------------------------------------------


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


@query
def station_summary(spark, d):
    return _rounded(A.station_summary(shortlist(spark, d), new_jobs(spark, d)), "median_score", "median_distance_km")


@query
def industry_summary(spark, d):
    return _rounded(A.industry_summary(shortlist(spark, d), new_jobs(spark, d)), "median_distance_km")


@query
def tag_summary(spark, d):
    return _rounded(A.tag_summary(new_jobs(spark, d), shortlist(spark, d)), "median_distance_km")


@query
def kpi(spark, d):
    return A.kpi(new_jobs(spark, d), shortlist(spark, d), stats(spark, d))


@query
def top_companies(spark, d):
    return _rounded(A.top_companies(shortlist(spark, d), new_jobs(spark, d), jobs_raw(spark, d), 50), "distance_km")


@query
def quality_alerts(spark, d):
    return A.quality_alerts(view(spark, d))


@query
def jobs_by_company(spark, d):
    return A.jobs_by_company(new_jobs(spark, d), shortlist(spark, d))


@query
def jobs_by_tag(spark, d):
    return A.jobs_by_tag(new_jobs(spark, d))


@query
def map_bounds(spark, d):
    out = A.map_bounds(companies(spark, d))
    return _rounded(out, "median_lat", "median_lon", "mean_lat", "mean_lon", "min_lat", "max_lat", "min_lon", "max_lon")


@query
def map_layer(spark, d):
    out = W.map_layer(view(spark, d), new_jobs(spark, d))
    return out.select("business_id", "color", r6("radius").alias("radius"), "status_rgba", "layers", "popup", "tooltip")


@query
def classifier_metrics(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    low = F.lower("text")
    predicted = F.when(F.contains(low, F.lit("that")), "yes").when(F.contains(low, F.lit("sch")), "no").otherwise("unclear")
    rows = docs.select(predicted.alias("predicted"), F.when(F.col("quality") == 1, "yes").otherwise("no").alias("label"))
    return _rounded(A.classifier_metrics(rows), "accuracy", "precision", "recall", "uncertain_rate")


@query
def geojson_features(spark, d):
    df = companies(spark, d).select("business_id", "lat", "lon", "name", "recruiting_active", "job_count_total")
    f = writers.geojson_features(df).select(F.try_parse_json("value").alias("f"))
    return f.select(
        F.try_variant_get("f", "$.properties.business_id", "string").alias("business_id"),
        F.try_variant_get("f", "$.type", "string").alias("type"),
        F.try_variant_get("f", "$.geometry.type", "string").alias("geometry"),
        r6(F.try_variant_get("f", "$.geometry.coordinates[0]", "double")).alias("x"),
        r6(F.try_variant_get("f", "$.geometry.coordinates[1]", "double")).alias("y"),
        F.try_variant_get("f", "$.properties.name", "string").alias("name"),
        F.try_variant_get("f", "$.properties.job_count_total", "bigint").alias("job_count_total"),
    )


@query
def latest_snapshot(spark, d):
    path = F.concat(
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("/out/master_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit(".parquet"))).otherwise(
            F.concat(F.lit("/out/run_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("/jobs/diff.parquet"))
        )
    )
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", snapshot_date(path).alias("run_date"))
    return latest_rows(df, "run_date")


# --- crawl ------------------------------------------------------------------------------------


@query
def crawl_stats(spark, d):
    return stats(spark, d)


@query
def crawl_status(spark, d):
    return stats(spark, d).groupBy("status").agg(F.count("*").alias("n_domains"))


@query
def crawl_coverage(spark, d):
    return W.crawl_coverage(stats(spark, d))


@query
def fetch_outcome(spark, d):
    return crawl.fetch_outcome(fetch_log(spark, d)).select("seq", "retryable", "outcome", "redirected")


@query
def domain_validation(spark, d):
    sites = site_companies(spark, d)
    listed = sites.select("business_id", "name", F.when(F.col("ord") % 9 == 0, F.lit("nan")).otherwise(F.col("domain")).alias("domain"))
    code = F.when(F.col("ord") % 4 == 1, F.lit(404)).when(F.col("ord") % 11 != 2, F.lit(200))
    home = F.concat(F.lit("https://"), "domain", F.when(F.col("ord") % 5 == 0, F.lit("/start")).otherwise(F.lit("/")))
    fetched = (
        sites.join(site_pages(spark, d).select(F.col("page_id").alias("ord"), "html"), "ord")
        .withColumn("html", F.when(F.col("ord") % 3 == 0, F.concat("html", F.lit("<p>Hyväksy</p>"))).otherwise(F.col("html")))
        .select("domain", code.cast("int").alias("status_code"), home.alias("final_url"), "html", F.lit("dns").alias("error"), F.lit(0).alias("ord"))
    )
    again = fetched.withColumns({"status_code": F.lit(500), "ord": F.lit(1)})
    fetched = fetched.unionByName(again)
    return crawl.validate_domains(listed, fetched)


@query
def page_budget(spark, d):
    return crawl.page_budget(site_pages(spark, d), 3, "page_id").select("domain", "page_id")


@query
def site_candidates(spark, d):
    out = crawl.site_candidates(site_companies(spark, d), site_pages(spark, d), paths=SITE_PATHS)
    return out.select("business_id", "ord", "url", "page_id")


@query
def access_gate(spark, d):
    c = site_pages(spark, d).select("page_id", "url")
    out = crawl.access_gate(c, access_rules(spark, d), ["ththin.example.com"])
    return out.select("page_id", "allowed", "skip_reason")


# --- pages ------------------------------------------------------------------------------------


@query
def page_text(spark, d):
    out = P.page_text(site_pages(spark, d))
    return out.select("page_id", "title", "text")


@query
def page_links(spark, d):
    return P.page_links(site_pages(spark, d), VOCABULARY.url_hints, VOCABULARY.text_hints)


@query
def resolve_url(spark, d):
    n = F.col("page_id").cast("string")
    href = (
        F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("/a/./b/../c"), n))
        .when(F.col("page_id") % 10 == 1, F.concat(F.lit("../up"), n))
        .when(F.col("page_id") % 10 == 2, F.concat(F.lit("//cdn.example/x"), n))
        .when(F.col("page_id") % 10 == 3, F.concat(F.lit("?q="), n))
        .when(F.col("page_id") % 10 == 4, F.lit("#part"))
        .when(F.col("page_id") % 10 == 5, F.concat(F.lit("mailto:a@b"), n))
        .when(F.col("page_id") % 10 == 6, F.concat(F.lit("HTTPS://Other.example/"), n))
        .when(F.col("page_id") % 10 == 7, F.concat(F.lit("leaf"), n, F.lit("?a=../b#c")))
        .when(F.col("page_id") % 10 == 8, F.lit(""))
        .otherwise(F.lit("../../../../deep/.."))
    )
    return site_pages(spark, d).select("page_id", U.resolve_url(F.col("url"), href).alias("target"))


@query
def url_class(spark, d):
    links = P.page_links(site_pages(spark, d), [""], [])
    return P.url_classes(links.withColumn("target", F.concat("target", F.when(F.col("ord") % 4 == 0, F.lit("/?utm_source=x")).otherwise(F.lit("")))), VOCABULARY, "target").select(
        "page_id", "ord", "is_listing", "is_non_job"
    )


@query
def consent_pages(spark, d):
    return P.consent_pages(site_pages(spark, d), VOCABULARY).select("page_id", "is_consent")


@query
def cookie_wall(spark, d):
    out = P.cookie_wall(P.page_text(site_pages(spark, d)), VOCABULARY)
    return out.select("page_id", "is_wall", "wall_hits", r6("wall_score").alias("wall_score"), joined("wall_matches").alias("matches"), joined("wall_signals").alias("signals"))


def ats_pages(spark, d):
    n = F.col("page_id").cast("string")
    m = F.col("page_id") % 8
    url = (
        F.when(m == 0, F.concat(F.lit("https://jobs.lever.co/co"), n, F.lit("/x")))
        .when(m == 1, F.concat(F.lit("https://boards.greenhouse.io/co"), n))
        .when(m == 2, F.concat(F.lit("https://co"), n, F.lit(".recruitee.com/o/1")))
        .when(m == 3, F.concat(F.lit("https://co"), n, F.lit(".teamtailor.com/jobs")))
        .when(m == 4, F.lit("https://www.clever.com/page"))
        .otherwise(F.col("url"))
    )
    extra = F.when(F.col("page_id") % 11 == 5, F.lit("<a href='https://boards.greenhouse.io/x'>")).when(F.col("page_id") % 11 == 6, F.lit("<script src='https://hire.lever.co/x.js'></script>")).otherwise(F.lit(""))
    return site_pages(spark, d).select("page_id", url.alias("url"), F.concat("html", extra).alias("html"))


@query
def ats_detect(spark, d):
    return ats_pages(spark, d).select("page_id", P.detect_ats(F.col("url"), F.col("html")).alias("a")).select("page_id", "a.kind", "a.slug")


@query
def sitemap_urls(spark, d):
    p = site_pages(spark, d)
    xml = F.concat(
        F.lit("<?xml version='1.0'?><urlset><url><loc> https://s.example/job/"), F.col("page_id").cast("string"), F.lit("?a=1&amp;b=2 </loc></url><url><LOC>"),
        F.regexp_replace("url", "&", "&amp;"), F.lit("</LOC></url><url><loc></loc></url><url><loc>https://s.example/about</loc></url></urlset>"),
    )
    return P.sitemap_urls(p.select(F.concat(F.lit("s"), F.col("page_id").cast("string")).alias("domain"), xml.alias("xml")), ["job", "/en/"])


@query
def job_signal(spark, d):
    return P.job_signal(site_pages(spark, d), VOCABULARY).select("page_id", "has_signal")


@query
def json_ld_jobs(spark, d):
    p = site_pages(spark, d)
    n = F.col("page_id").cast("string")
    one = F.concat(F.lit('{"@type":"JobPosting","title":"Urgent role '), n, F.lit('","url":"/jobs/'), n, F.lit('","description":"<b>Bring</b> high&nbsp;spirits","jobLocation":{"address":{"addressLocality":"City '), n, F.lit('"}},"employmentType":"full-time","datePosted":"2024-01-01"}'))
    two = F.concat(F.lit('{"@type":["Thing","JobPosting"],"title":"Low '), n, F.lit('","employmentType":["a"]}'))
    block = (
        F.when(F.col("page_id") % 4 == 0, one)
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit('{"@graph":['), one, F.lit(","), two, F.lit(',{"@type":"Person"}]}')))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("["), two, F.lit(",7]")))
        .otherwise(F.lit('{"@type":"JobPosting", broken'))
    )
    html = F.concat(F.lit("<script type='application/ld+json'>"), block, F.lit("</script>"), "html")
    pages = p.select(F.concat(F.lit("P"), n).alias("business_id"), F.lit("n").alias("name"), U.authority(F.col("url")).alias("domain"), "url", html.alias("html"))
    out = X.jobs_from_json_ld(pages, CRAWL_TS, VOCABULARY)
    return out.select("company_business_id", "job_title", "job_url", "location_text", "employment_type", "posted_date", "description_snippet", joined("tags").alias("tags"))


@query
def feed_jobs(spark, d):
    o = spread(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"))
    n = F.col("o_orderkey").cast("string")
    kind = F.when(F.col("o_orderkey") % 4 == 0, "lever").when(F.col("o_orderkey") % 4 == 1, "greenhouse").when(F.col("o_orderkey") % 4 == 2, "recruitee").otherwise("teamtailor")
    lever = F.concat(F.lit('[{"text":"Role '), n, F.lit('","applyUrl":"https://l.example/'), n, F.lit('","categories":{"location":"Lahti","commitment":"Full"},"description":"<p>'), F.col("o_orderpriority"), F.lit('</p>","createdAt":1700000000000}]'))
    green = F.concat(F.lit('{"jobs":[{"title":"Job '), n, F.lit('","absolute_url":"https://g.example/'), n, F.lit('","location":{"name":"Espoo"},"updated_at":"2024-02-03","content":"'), F.col("o_orderpriority"), F.lit(' &amp; more"},{"title":"Second '), n, F.lit('"}]}'))
    rec = F.concat(F.lit('{"offers":[{"title":"Offer '), n, F.lit('","url":"https://r.example/'), n, F.lit('","location":"Turku","created_at":"2024-03-04"}]}'))
    payload = F.when(kind == "lever", lever).when(kind == "greenhouse", green).when(kind == "recruitee", rec).otherwise(F.lit("{}"))
    feeds = o.select(kind.alias("kind"), n.alias("business_id"), F.lit("n").alias("name"), F.lit("x.example").alias("domain"), payload.alias("payload"))
    out = X.jobs_from_feeds(feeds, CRAWL_TS, VOCABULARY)
    return out.select("company_business_id", "job_title", "job_url", "location_text", "employment_type", "posted_date", "description_snippet", "source", joined("tags").alias("tags"))


def list_pages(spark, d):
    """Pages whose links point at other landed pages: every page links to the pages after it."""
    p = site_pages(spark, d)
    nxt = p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("u1"))
    after = p.select((F.col("page_id") - 3).alias("page_id"), F.col("url").alias("u2"))
    html = F.concat(
        F.lit("<a href='"), F.coalesce("u1", F.lit("/none")), F.lit("'>one</a><a href='"), F.coalesce("u2", F.lit("/none")), F.lit("'>ing two</a><a href='"),
        F.coalesce("u1", F.lit("/none")), F.lit("#x'>again</a>"), "html",
    )
    return p.join(nxt, "page_id", "left").join(after, "page_id", "left").select(
        "page_id", "url", html.alias("html"), F.concat(F.lit("P"), F.col("page_id").cast("string")).alias("business_id"), F.lit("n").alias("name"), U.authority(F.col("url")).alias("domain")
    )


GENERIC = VOCABULARY.__class__(**{**VOCABULARY.__dict__, "url_hints": ["http", "/th"], "consent_words": ["oiç", "ción", "los "], "consent_pair": ["thth", "ver"]})


@query
def generic_jobs(spark, d):
    jobs, _ = X.generic_jobs(list_pages(spark, d), site_pages(spark, d), CRAWL_TS, GENERIC)
    return jobs.select("company_business_id", "company_domain", "job_title", "job_url", "description_snippet", joined("tags").alias("tags"))


@query
def generic_job_errors(spark, d):
    _, errors = X.generic_jobs(list_pages(spark, d), site_pages(spark, d), CRAWL_TS, GENERIC)
    return errors.groupBy("page_id", "error").agg(F.count("*").alias("n"))


# --- verdicts and documents -------------------------------------------------------------------


@query
def page_verdict(spark, d):
    out = S.page_verdict(ats_pages(spark, d), VOCABULARY)
    return out.select("page_id", "signal", "confidence", "evidence", joined("evidence_snippets").alias("snippets"), joined("evidence_urls").alias("urls"))


@query
def evidence_gate(spark, d):
    out = S.evidence_gate(answers(spark, d))
    return out.select("answer_id", "signal", "confidence", "evidence", joined("evidence_snippets").alias("snippets"), joined("evidence_urls").alias("urls"))


@query
def best_verdict(spark, d):
    out = S.best_verdict(S.evidence_gate(answers(spark, d)), "business_key", "answer_id")
    return out.select("business_key", "answer_id", "signal", "confidence")


@query
def evidence_downgrade(spark, d):
    p = site_pages(spark, d)
    host = U.authority(F.col("url"))
    other = F.concat(F.lit("https://jobs.lever.co/x"), F.col("page_id").cast("string"))
    urls = F.when(F.col("page_id") % 4 == 0, F.array("url", other)).when(F.col("page_id") % 4 == 1, F.array("url", "url")).when(F.col("page_id") % 4 == 2, F.array(F.lit("https://elsewhere.example"), F.lit("x"))).otherwise(F.array(F.concat(F.lit("https://jobs."), host, F.lit("/1")), other))
    signal = F.when(F.col("page_id") % 7 == 0, "no").when(F.col("page_id") % 7 == 1, "unclear").otherwise("YES")
    rows = p.select("page_id", host.alias("domain"), signal.alias("signal"), F.lit(0.9).alias("confidence"), urls.alias("evidence_urls"))
    return S.evidence_downgrade(rows).select("page_id", "hiring_status", "hiring_confidence", joined("hiring_reasons").alias("reasons"))


@query
def cookie_wall_company(spark, d):
    p = site_pages(spark, d).withColumn("business_id", U.authority(F.col("url")))
    walls = P.cookie_wall(P.page_text(p), VOCABULARY)
    return S.strongest_wall(walls, "business_id", "page_id").select("business_id", "page_id", r6("wall_score").alias("wall_score"), joined("wall_signals").alias("signals"))


@query
def career_suggestion(spark, d):
    sites = site_companies(spark, d)
    board = F.when(F.col("ord") % 3 == 0, F.concat(F.lit("https://boards.greenhouse.io/co"), F.col("ord").cast("string")))
    own = P.page_links(site_pages(spark, d), VOCABULARY.url_hints, VOCABULARY.text_hints).join(
        sites.select("business_id", F.col("ord").alias("page_id")), "page_id"
    ).select("business_id", "ord", F.col("target").alias("link"))
    pages = site_pages(spark, d).select("page_id", U.authority(F.col("url")).alias("domain"), "url").join(sites.select("domain", "business_id"), "domain")
    linked = pages.select("business_id", (F.col("page_id") + 1000).cast("int").alias("ord"), F.col("url").alias("link"))
    boards = sites.select("business_id", F.lit(500).alias("ord"), board.alias("link")).where("link IS NOT NULL")
    signals = P.job_signal(site_pages(spark, d), VOCABULARY).where("has_signal").select(U.url_key(F.col("url")).alias("url_key"))
    return P.career_suggestions(sites.select("business_id", "name", "domain"), own.unionByName(linked).unionByName(boards), signals, SITE_PATHS)


def scan_summary(spark, d, keys, answers=None):
    pages = ats_pages_same_url(spark, d)
    scanned = hiring.scan(site_companies(spark, d, keys), pages, access_rules(spark, d, keys), answers=answers, vocabulary=VOCABULARY, paths=SITE_PATHS)
    return hiring.scan_summary(scanned)


def ats_pages_same_url(spark, d):
    extra = F.when(F.col("page_id") % 11 == 5, F.lit("<a href='https://boards.greenhouse.io/x'>")).otherwise(F.lit(""))
    return site_pages(spark, d).withColumn("html", F.concat("html", extra))


@query
def hiring_signal(spark, d):
    keys = page_keys(spark, d)
    return _signal_rows(spark, d, keys, scan_summary(spark, d, keys))


@query
def hiring_signal_answers(spark, d):
    """The same run where a conversation's answers speak of the page with its number; several turns answer one page."""
    said = answers(spark, d).select(F.floor(F.col("answer_id") / 100).alias("page_id"), F.col("turn").alias("ord"), *S.VERDICT_COLUMNS)
    keys = page_keys(spark, d)
    return _signal_rows(spark, d, keys, scan_summary(spark, d, keys, said))


def _signal_rows(spark, d, keys, summary):
    out = hiring.hiring_signal(site_companies(spark, d, keys), summary, RUN)
    return out.select(
        "run_id", "business_id", "name", "domain", "signal", "confidence", "evidence", joined("evidence_snippets").alias("snippets"),
        joined("evidence_urls").alias("urls"), "signal_url", "checked_urls", "errors", "skipped_reason", "prompt_version", "llm_used", "output_format",
    )


def packages(spark, d):
    """One request per page; the place lookup leads to the site of the page's host."""
    keys = page_keys(spark, d)
    requests = maps_links(spark, d, keys).select(
        F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("run_id"), "maps_url", "page_id", "url",
        F.when(F.col("page_id") % 5 == 0, F.lit("call")).alias("note"), F.when(F.col("page_id") % 4 == 0, F.array(F.lit("a"), F.lit("b"))).alias("tags"),
    )
    websites = requests.select(
        U.place_id("maps_url").alias("place_id"),
        F.when(F.col("page_id") % 5 != 2, F.col("url")).alias("website_url"),
        F.when(F.col("page_id") % 13 == 1, F.lit("http_500")).alias("lookup_error"),
    ).where("place_id IS NOT NULL")
    resolved = hiring.resolve_requests(requests.select("run_id", "maps_url", "note", "tags"), websites)
    targets = resolved.where("domain <> ''").select(F.col("run_id").alias("business_id"), "domain", "website_url")
    scanned = hiring.scan(targets, ats_pages_same_url(spark, d), access_rules(spark, d, keys), vocabulary=VOCABULARY, paths=SITE_PATHS)
    return hiring.company_packages(resolved, hiring.scan_summary(scanned), RUN)


@query
def company_package(spark, d):
    p = packages(spark, d)
    return p.select(
        "run_id", "package.status", "package.degraded_reason", F.col("package.source.place_id").alias("place_id"),
        F.col("package.source.canonical_domain").alias("canonical_domain"), F.col("package.hiring.status").alias("hiring_status"),
        F.col("package.hiring.confidence").alias("hiring_confidence"), joined("package.hiring.signals").alias("signals"),
        F.size("package.hiring.evidence").cast("long").alias("n_evidence"), joined("package.safety.errors").alias("errors"),
        F.col("package.safety.cookie_wall.detected").alias("wall"), "package.next_action", F.col("package.error.code").alias("error_code"),
    )


@query
def dossier_markdown(spark, d):
    return hiring.dossier_markdown(packages(spark, d))


@query
def package_violations(spark, d):
    return contract.package_violations(hiring.package_json(packages(spark, d)))


#: A package that keeps its contract, and what breaks it: text to replace, with what, by the remainder of the page number.
GOOD_PACKAGE = (
    '{"status":"ok","degraded_reason":"none","schema_version":"1","run_id":"@","created_at":"t","tool_version":"v","git_sha":"g",'
    '"source":{"source_ref":"x","place_id":"p","canonical_domain":"d","website_source":"places","resolver_notes":""},'
    '"hiring":{"status":"yes","confidence":0.5,"signals":["s"],"evidence":[{"snippet":"s1","url":"u1"},{"snippet":"s2","url":"u2"}]},'
    '"links":{"maps_url":"m","website_url":"w","careers_urls":[],"ats_urls":["a"],"contact_url":""},"next_action":"",'
    '"safety":{"robots_respected":"true","pages_fetched":2,"skipped_reasons":[],"errors":[],"checked_urls":["c"],"cookie_wall":{"detected":false,"score":0.2,'
    '"hit_count":1,"signals":[],"threshold":{"hits_min":2,"score_min":0.4,"text_max_len":2000,"hits_hard":5},"matches":["m"]},"llm_used":false,'
    '"prompt_version":"p","ollama_model":"","ollama_temperature":0.1,"deterministic":true},"notes":{"note":"","tags":["a","b"]}}'
)
BREAKS = [
    ('"status":"ok"', '"status":"odd @"'), ('"confidence":0.5', '"confidence":"high"'), ('"snippet":"s1"', '"snippet":@'), ('"git_sha":"g",', ""),
    ('"hits_min":2', '"hits_min":2.5'), ('"tags":["a","b"]', '"tags":["a",null]'), (',"url":"u2"', ""), ('"place_id":"p",', ""),
    ('"llm_used":false', '"llm_used":"no"'), ('"pages_fetched":2', '"pages_fetched":[@]'), ('}}', ""), ('"links":{', '"links":7,"rest":{'),
]


@query
def package_schema_violations(spark, d):
    k = F.col("page_id") % 14
    text = F.lit(GOOD_PACKAGE)
    for i, (old, new) in enumerate(BREAKS):
        text = F.when(k == i, F.lit(GOOD_PACKAGE.replace(old, new))).otherwise(text)
    docs = site_pages(spark, d).select("page_id", F.replace(text, F.lit("@"), F.col("page_id").cast("string")).alias("package"))
    return contract.package_violations(docs, "page_id")


@query
def bad_lines(spark, d):
    """Lines of an audit log, some broken: how many bad ones per file and reason, and how many rows."""
    n = F.col("o_orderkey").cast("string")
    k = F.col("o_orderkey") % 9
    good = F.concat(F.lit('{"ts":"2024-01-01","batch_id":"b'), n, F.lit('","changed_rows":'), n, F.lit("}"))
    value = F.when(k == 0, F.concat(F.lit('{"ts":"'), n)).when(k == 1, F.concat(n, F.lit(" rows"))).when(k == 2, F.concat(F.lit('{"batch_id":"'), n, F.lit('","changed_rows":"many"}')))
    value = value.when(k == 3, F.lit("  ")).when(k == 4, F.concat(F.lit("["), n, F.lit("]"))).otherwise(good)
    lines = table(spark, d, "orders").select(F.concat(F.lit("f"), (F.col("o_orderkey") % 2).cast("string")).alias("file"), value.alias("value"))
    rows, bad = split_lines(lines, schemas.AUDIT)
    whole = rows.select(F.lit("").alias("file"), F.lit("row").alias("reason"), "batch_id").groupBy("file", "reason").agg(F.count("batch_id").alias("n_lines"))
    return bad_line_counts(bad).unionByName(whole)


@query
def contract_violations(spark, d):
    df = bound(spark, d, "model_answers")
    k = F.col("answer_id")
    bad = df.select(
        "answer_id",
        *[F.lit("x").alias(c) for c in ("run_id", "tool_version", "git_sha", "crawl_ts", "station", "business_id", "name", "domain", "evidence", "signal_url", "checked_urls", "next_url_hint", "errors", "skipped_reason", "ollama_model", "prompt_version")],
        F.when(k % 5 == 0, "12").when(k % 5 == 1, "far").alias("max_distance_km"),
        F.when(k % 4 == 0, "YES").when(k % 4 == 1, "perhaps").when(k % 4 == 2, "").otherwise("no").alias("signal"),
        F.when(k % 6 == 0, "0.5").when(k % 6 == 1, "1.5").when(k % 6 == 2, "abc").when(k % 6 == 3, "-0.1").alias("confidence"),
        F.when(k % 3 == 0, '["a"]').when(k % 3 == 1, "[broken").otherwise("a;b").alias("evidence_snippets"),
        F.lit("").alias("evidence_urls"),
        F.when(k % 7 == 0, "hot").otherwise("0.2").alias("ollama_temperature"),
        F.when(k % 8 == 0, "True").when(k % 8 == 1, "0").when(k % 8 == 2, "often").otherwise("n").alias("llm_used"),
        F.when(k % 9 == 0, "never").when(k % 9 == 1, "f").alias("deterministic"),
        F.when(k % 10 == 0, "xml").otherwise("CSV").alias("output_format"),
    )
    return contract.signal_violations(bad, "answer_id")


# --- shaping of sources and sinks -------------------------------------------------------------


@query
def domain_map_rows(spark, d):
    """The mapping as it is landed: blank ids and domains, addresses in place of domains."""
    blank = F.col("ord") % 10 == 0
    df = companies(spark, d).select(F.when(~blank, F.concat(F.lit(" "), "business_id")).otherwise(F.lit(" ")).alias("business_id"), "name", F.col("website_url").alias("domain"))
    return readers.domain_map_rows(df).select("business_id", "domain")


@query
def station_rows(spark, d):
    n = F.col("n_nationkey")
    df = table(spark, d, "nation").select(
        F.col("n_name").alias("station_name"), F.when(n % 5 != 0, F.lit(60.0) + n * 0.2).alias("lat"), F.lit(22.0).alias("lon"),
        F.when(n % 2 == 0, F.lit("FI")).when(n % 3 == 0, F.lit("SE")).alias("country"),
    )
    return readers.station_rows(df).select("station_name", r6("lat").alias("lat"))


@query
def signal_csv_rows(spark, d):
    df = S.evidence_gate(answers(spark, d)).select("answer_id", "evidence_snippets", "evidence_urls")
    return writers.csv_rows(df)


@query
def known_jobs_state(spark, d):
    """State after a run that keeps the older postings."""
    return J.next_state(flagged(spark, d), known(spark, d)).select("job_url", "job_fingerprint")


@query
def outreach_rows(spark, d):
    return writers.outreach(shortlist(spark, d).where("score >= 5"), {"filter": "score >= 5"})["outreach"].select("business_id", "name")


@query
def audit_row(spark, d):
    diff = O.edit_diff(overlay(spark, d), _after(spark, d))
    out = writers.audit_event(diff, ts="2024-02-01T00:00:00", batch_id="b1", source_master="m2", overlay_path="overlay", backup=None)
    return out.select("ts", "batch_id", "changed_rows", "source_master", "curation_path", "backup_path")


@query
def scan_run(spark, d):
    """From companies to contract rows: mapped domains, one station within a distance, candidates, gate, verdicts."""
    keys = page_keys(spark, d)
    hosts = site_companies(spark, d, keys)
    located = shortlist(spark, d).withColumn("website_url", F.lit(None).cast("string")).withColumn("domain", F.when(F.col("ord") % 5 == 0, F.col("domain")))
    mapped = hosts.select(F.col("ord").alias("page_id"), F.col("domain")).join(companies(spark, d).select(F.col("ord").alias("page_id"), "business_id"), "page_id")
    chosen = L.scan_targets(C.domain_ladder(located, mapped.select("business_id", "domain")), station="nation_3", max_distance_km=400.0)
    scanned = hiring.scan(chosen, ats_pages_same_url(spark, d), access_rules(spark, d, keys), vocabulary=VOCABULARY, paths=SITE_PATHS)
    out = hiring.hiring_signal(chosen, hiring.scan_summary(scanned), RUN)
    return out.select("business_id", "domain", "signal", "confidence", "checked_urls", "errors", "skipped_reason")


# --- recurring runs ---------------------------------------------------------------------------


@query
def activity_sliding(spark, d):
    out = streams.sliding_activity_batch(table(spark, d, "events"), "user_id", "ts")
    return out.select("user_id", F.col("window_start").cast("string").alias("window_start"), "n_events")


@query
def company_run(spark, d):
    registry = _registry(spark, d).withColumn("mainBusinessLine", F.struct((F.col("ord") * 13 % 90 + 10).cast("string").alias("type")))
    kept, _ = runs.company_run(registry, stations(spark, d), _run_cache(spark, d), activity(spark, d), radius_km=15.0, allow=["62", "1"], deny=["47"])
    return kept.select("business_id", "name", "city", "industry", "nearest_station", r6("distance_km").alias("distance_km"), F.col("score").cast("long").alias("score"), "score_reasons")


def _run_cache(spark, d):
    """A coordinate for every second address."""
    a = C.normalize_registry(_registry(spark, d)).select("full_address", "ord").groupBy("full_address").agg(F.min("ord").alias("k"))
    return a.where("k % 2 = 0").select(
        F.col("full_address").alias("address"), (F.lit(60.0) + (F.col("k") * 37 % 500) / 100.0).alias("lat"), (F.lit(22.0) + (F.col("k") * 53 % 750) / 100.0).alias("lon"), F.lit("t").alias("ts")
    )


for _old, _new in (("pick_first_query", "pick_first"), ("detect_tags_query", "detect_tags"), ("snippets_query", "snippets")):
    QUERIES[_new] = QUERIES.pop(_old)
