import random

import pytest
from pyspark.sql import functions as F

from hireatlas import rules, schemas
from hireatlas.operators import companies as C, industry as I, nearby
from hireatlas.plans import runs

NAMES = "array<struct<name:string,type:string,registrationDate:string,endDate:string>>"
ADDRESSES = "array<struct<street:string,postCode:string,city:string>>"
REGISTRY = f"ord long, businessId string, name string, names {NAMES}, addresses {ADDRESSES}, _source_city string, domicile string, companyForm string, companyForms array<struct<name:string,type:string>>, mainBusinessLine struct<type:string>"


def test_normalize_picks_name_address_and_industry(rows):
    df = rows(
        REGISTRY,
        [
            {
                "ord": 1, "businessId": " 0123456-7 ", "name": "Plain",
                "names": [("Ended", "1", "2020-01-01", "2021-01-01"), ("Old", "1", "2001-01-01", None), ("Now", "1", "2015-01-01", None), ("Side", "3", "2022-01-01", None)],
                "addresses": [("Katu 1", "00100", "Espoo"), (None, "15100", "Lahti")], "_source_city": "Lahti", "mainBusinessLine": ("62010",),
                "companyForms": [("Osakeyhtiö", "16")],
            },
            {"ord": 2, "businessId": None, "name": "Only", "domicile": "Hämeenlinna", "mainBusinessLine": None},
        ],
    )
    a, b = C.normalize_registry(df).orderBy("ord").collect()
    assert (a["business_id"], a["name"], a["industry"], a["company_form"]) == ("0123456-7", "Now", "it", "OSAKEYHTIÖ")
    # the matching address has no street: the first address keeps its own
    assert (a["street"], a["post_code"], a["city"], a["full_address"]) == ("Katu 1", "15100", "Lahti", "Katu 1, 15100, Lahti")
    assert (b["business_id"], b["name"], b["city"], b["full_address"], b["industry"]) == ("", "Only", "Hämeenlinna", "Hameenlinna", "other")


def test_registry_spellings(rows):
    df = rows(
        "ord long, businessId struct<value:string>, name string, names string, main_business_line string, mainBusinessLine string, companyForms string",
        [{"ord": 1, "businessId": ("7",), "name": "Row", "names": "[{'name': 'Old', 'endDate': '2020-01-01'}, {'name': 'Now', 'type': '1', 'endDate': None}]", "main_business_line": " ", "mainBusinessLine": "62.01", "companyForms": "[{'name': None, 'type': 'As Oy'}]"}],
    )
    r = C.normalize_registry(df).first()
    assert (r["business_id"], r["name"], r["industry"], r["company_form"]) == ("7", "Now", "it", "AS OY")
    plain = rows("ord long, business_id string, name string, main_business_line struct<type:string>", [{"ord": 1, "business_id": "9", "name": "Row", "main_business_line": ("47",)}])
    r = C.normalize_registry(plain).first()
    assert (r["business_id"], r["name"], r["industry"]) == ("9", "Row", "retail")


def test_official_name_falls_back_to_ended_names(rows):
    df = rows(f"id long, names {NAMES}", [{"id": 1, "names": [("A", "2", "2019-01-01", "2020-01-01"), ("B", "1", "2001-01-01", "2002-01-01")]}, {"id": 2, "names": []}, {"id": 3, "names": None}])
    got = [r["n"] for r in df.orderBy("id").select(C.official_name(F.col("names")).alias("n")).collect()]
    assert got == ["B", None, None]


def test_housing_and_exclusion(rows):
    df = rows(
        "id long, form string, name string",
        [
            {"id": 1, "form": "ASUNTO-OSAKEYHTIÖ", "name": "X"}, {"id": 2, "form": "OY", "name": "As. Oy Puisto"}, {"id": 3, "form": "OY", "name": "Kiinteistö Oy Talo"},
            {"id": 4, "form": "OY", "name": "Asuntola Oy"}, {"id": 5, "form": "", "name": None}, {"id": 6, "form": "OY", "name": "Kas oy"},
        ],
    )
    got = [r["r"] for r in df.orderBy("id").select(C.exclude_reason(F.col("form"), F.col("name")).alias("r")).collect()]
    assert got == ["company_form:ASUNTO-OSAKEYHTIÖ", "name_match:housing", "name_match:housing", None, None, None]


def test_industry_gate(rows):
    df = rows("id long, line string", [{"id": 1, "line": "IT consulting"}, {"id": 2, "line": "Gambling and IT"}, {"id": 3, "line": "Retail"}, {"id": 4, "line": None}])
    got = [tuple(r["g"]) for r in df.orderBy("id").select(C.industry_gate(F.col("line"), ["consult", "it"], ["gambling"]).alias("g")).collect()]
    assert got == [(True, "whitelist:consult", False), (False, "blacklist:gambling", True), (False, "not_in_whitelist", False), (False, "not_in_whitelist", False)]
    open_gate = [tuple(r["g"]) for r in df.orderBy("id").select(C.industry_gate(F.col("line"), [], []).alias("g")).collect()]
    assert set(open_gate) == {(True, None, False)}


def test_industry_longest_prefix_and_both_forms_agree(spark, rows):
    groups = {"a": ["6"], "b": ["62", "7"], "c": ["620", "7"]}
    df = rows("code string", [{"code": c} for c in ("62.01", "61", "70", "99", "", None, "6")])
    inline = {r["code"]: r["g"] for r in df.select("code", I.classify(F.col("code"), groups).alias("g")).collect()}
    assert inline == {"62.01": "c", "61": "a", "70": "b", "99": "other", "": "other", None: "other", "6": "a"}
    table = spark.createDataFrame([(g, i, p) for i, (g, ps) in enumerate(groups.items()) for p in ps], "group string, ord int, prefix string")
    assert {r["code"]: r["industry"] for r in I.classify_by_table(df, "code", table).collect()} == inline


def test_dedup_prefers_coordinates_and_keeps_blank_ids(rows):
    df = rows(
        "ord long, business_id string, lat double, lon double, name string",
        [
            {"ord": 1, "business_id": "a", "name": "first"}, {"ord": 2, "business_id": "a", "lat": 60.0, "lon": 25.0, "name": "geo"}, {"ord": 3, "business_id": "a", "lat": 61.0, "lon": 25.0, "name": "later"},
            {"ord": 4, "business_id": "b", "name": "one"}, {"ord": 5, "business_id": "b", "name": "two"}, {"ord": 6, "business_id": " "}, {"ord": 7, "business_id": " "}, {"ord": 8, "business_id": None},
        ],
    )
    assert sorted(r["ord"] for r in C.deduplicate(df).collect()) == [2, 4, 6, 7, 8]


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_dedup_does_not_depend_on_partitioning(spark, parts):
    data = [(i, f"k{i % 7}" if i % 3 else "hot", 60.0 if i % 5 == 0 else None, 25.0) for i in range(300)]
    random.Random(parts).shuffle(data)
    df = spark.createDataFrame(data, "ord long, business_id string, lat double, lon double").repartition(parts)
    want = {}
    for o, k, lat, _ in sorted(data):
        best = want.get(k)
        if best is None or (best[1] is None and lat is not None):
            want[k] = (o, lat)
    assert {r["business_id"]: r["ord"] for r in C.deduplicate(df).collect()} == {k: v[0] for k, v in want.items()}


def test_nearest_both_ways_and_radius_agree_with_brute_force(spark):
    rng = random.Random(7)
    stations = [(i, f"S{i}", rng.uniform(-85, 85), rng.uniform(-180, 180)) for i in range(60)] + [(60, "twin", 10.0, 20.0), (61, "twin2", 10.0, 20.0)]
    companies = [(f"c{i}", rng.uniform(-89, 89), rng.uniform(-180, 180)) for i in range(120)] + [("t", 10.0, 20.1), ("edge", 0.0, 179.999), ("none", None, 25.0)]
    s = spark.createDataFrame(stations, "ord long, station_name string, lat double, lon double")
    c = spark.createDataFrame(companies, "business_id string, lat double, lon double")
    from math import asin, cos, radians, sin, sqrt

    def km(a, b, x, y):
        h = sin(radians(x - a) / 2) ** 2 + cos(radians(a)) * cos(radians(x)) * sin(radians(y - b) / 2) ** 2
        return 2 * 6371.0088 * asin(sqrt(min(1.0, h)))

    want = {i: (min((km(la, lo, x, y), o, n) for o, n, x, y in stations) if la is not None else (None, None, None)) for i, la, lo in companies}
    for compiled in (True, False):
        got = {r["business_id"]: r for r in nearby.nearest_station(c, s, compiled=compiled).collect()}
        assert len(got) == len(companies)
        for i, (d, _, n) in want.items():
            assert got[i]["nearest_station"] == n
            assert d is None and got[i]["distance_km"] is None or abs(got[i]["distance_km"] - d) < 1e-6
    pairs = {(r["business_id"], r["station_name"]) for r in nearby.radius_join(c, s, 900.0).collect()}
    assert pairs == {(i, n) for i, la, lo in companies if la is not None for _, n, x, y in stations if km(la, lo, x, y) <= 900.0}


def test_nearest_is_the_same_for_a_list_written_out_and_a_long_one(spark, monkeypatch):
    stations = [(9, "late", 10.0, 20.0), (3, "early", 10.0, 20.0), (None, "unnumbered", -40.0, 7.0), (5, "numbered", -40.0, 7.0), (1, None, 60.0, 25.0), (7, "off", None, 25.0)]
    s = spark.createDataFrame(stations, "ord long, station_name string, lat double, lon double")
    nan = float("nan")
    places = [("a", 10.0, 20.5), ("b", -41.0, 7.0), ("c", 61.0, 25.0), ("d", None, 1.0), ("e", nan, 1.0)]
    c = spark.createDataFrame(places, "business_id string, lat double, lon double")
    results = []
    for limit in (100, 0):
        monkeypatch.setattr(nearby, "WRITTEN_OUT", limit)
        results.append({r["business_id"]: r["nearest_station"] for r in nearby.nearest_station(c, s).collect()})
    assert results[0] == results[1] == {"a": "early", "b": "unnumbered", "c": None, "d": None, "e": "unnumbered"}
    assert {r["nearest_station"] for r in nearby.nearest_station(c, s.limit(0)).collect()} == {None}


def test_parse_address(rows):
    values = ["Katu 1, 15100 Lahti, Finland", "Lahti", "Katu 1, Lahti", "", None, "Tori, 00100, Suomi", "33100"]
    df = rows("id long, a string", [{"id": i, "a": v} for i, v in enumerate(values)])
    got = [tuple(r["p"]) for r in df.orderBy("id").select(C.parse_address(F.col("a")).alias("p")).collect()]
    assert got == [
        ("Katu 1", "15100", "Lahti"), ("Lahti", "", "Lahti"), ("Katu 1", "", "Lahti"), ("", "", ""), ("", "", ""), ("Tori", "00100", "00100"), ("33100", "33100", "33100"),
    ]


def test_master_from_places_keeps_the_closest_station(rows):
    ddl = "place_id string, name string, formatted_address string, lat double, lon double, types string, website string, business_status string"
    near = rows(ddl, [{"place_id": "p", "name": "X", "formatted_address": "A, 15100 Lahti, Finland", "lat": 61.0, "lon": 25.6, "website": "x.fi"}, {"place_id": " ", "name": "blank", "lat": 1.0, "lon": 1.0}])
    far = rows(ddl, [{"place_id": "p", "name": "X", "formatted_address": "A, 15100 Lahti, Finland", "lat": 61.0, "lon": 25.6, "website": "x.fi"}, {"place_id": "q", "name": "Y"}])
    out = {r["business_id"]: r for r in C.master_from_places([(far, "Far", 60.0, 25.0), (near, "Near", 61.0, 25.6)]).collect()}
    assert set(out) == {"p", "q"}
    assert out["p"]["nearest_station"] == "Near" and out["p"]["distance_km"] == 0.0 and out["p"]["city"] == "Lahti"
    assert out["q"]["distance_km"] is None and out["q"]["status"] == "neutral" and out["q"]["score"] == 0


def test_domain_ladder_and_fill(rows):
    companies = rows("business_id string, domain string", [{"business_id": "a", "domain": "own.fi"}, {"business_id": "b", "domain": ""}, {"business_id": "c", "domain": "nan"}, {"business_id": "d"}])
    mapped = rows("business_id string, domain string", [{"business_id": "a", "domain": "map.fi"}, {"business_id": "b", "domain": "map.fi"}, {"business_id": "c", "domain": " "}])
    suggested = rows("business_id string, domain string", [{"business_id": "c", "domain": "sug.fi"}])
    got = {r["business_id"]: r["domain"] for r in C.domain_ladder(companies, mapped, suggested).collect()}
    assert got == {"a": "own.fi", "b": "map.fi", "c": "sug.fi", "d": ""}
    sites = rows("business_id string, website_url string, ord long", [{"business_id": "a", "website_url": "https://new.fi/x", "ord": 1}, {"business_id": "b", "website_url": "https://new.fi/x", "ord": 1}])
    assert {r["business_id"]: r["domain"] for r in C.fill_domains(companies, sites).collect()} == {"a": "own.fi", "b": "new.fi", "c": "", "d": ""}


def test_score_sums_weights(rows):
    companies = rows(
        "business_id string, name string, company_form string, main_business_line string, distance_km double",
        [
            {"business_id": "good", "name": "Data Oy", "company_form": "OY", "main_business_line": "it", "distance_km": 0.4},
            {"business_id": "bad", "name": "As Oy Talo", "company_form": "AS OY", "main_business_line": "gambling", "distance_km": 0.4},
            {"business_id": "far", "name": "Far", "company_form": "OY", "main_business_line": "x", "distance_km": None},
        ],
    )
    activity = rows(
        "business_id string, job_count_total long, job_count_last_30d long, job_count_new_since_last long, recruiting_active boolean, tag_count_data long, tag_count_it_support long, tag_count_salesforce long, tag_count_oppisopimus long",
        [{"business_id": "good", "job_count_total": 2, "job_count_last_30d": 1, "job_count_new_since_last": 1, "recruiting_active": True, "tag_count_data": 1, "tag_count_it_support": 0, "tag_count_salesforce": 0, "tag_count_oppisopimus": 0}],
    )
    out = {r["business_id"]: (r["score"], r["score_reasons"]) for r in C.score_companies(companies, activity, radius_km=1.0, allow=["it"], deny=["gambling"]).collect()}
    assert out["good"] == (10, "loc_ok;industry_ok;recruiting_active;new_jobs;tag_data")
    assert out["bad"] == (-12, "loc_ok;industry_blacklist;excluded")
    assert out["far"] == (0, "")


def test_geocode_cache(rows):
    cache = rows("address string, lat double, lon double, ts string", [{"address": "A", "lat": 1.0, "lon": 2.0, "ts": "1"}, {"address": "A", "lat": 3.0, "lon": 4.0, "ts": "2"}])
    companies = rows("business_id string, full_address string", [{"business_id": "x", "full_address": "A"}, {"business_id": "y", "full_address": "B"}, {"business_id": "z", "full_address": ""}])
    hits = {r["business_id"]: (r["lat"], r["provider"]) for r in runs.geocode_hits(companies, cache).collect()}
    assert hits == {"x": (3.0, "cache"), "y": (None, None), "z": (None, None)}
    assert [r["address"] for r in runs.geocode_misses(companies, cache).collect()] == ["B"]
    answers = rows("address string, lat double, lon double, ts string", [{"address": "B", "lat": 5.0, "lon": 6.0, "ts": "3"}, {"address": "C", "ts": "3"}])
    assert {r["address"]: r["lat"] for r in runs.cache_merge(cache, answers).collect()} == {"A": 3.0, "B": 5.0}


def test_key_violations(rows):
    df = rows("business_id string", [{"business_id": v} for v in ("a", "a", "b", " ", None)])
    got = {(r["key"], r["problem"], r["n_rows"]) for r in C.key_violations(df).collect()}
    assert got == {("a", "duplicate", 2), ("", "blank", 2)}
    assert C.key_violations(df, limit=1).count() == 1


def test_conform_turns_nan_into_null_and_adds_columns(spark):
    df = spark.createDataFrame([("7", float("nan"), "x", "oops")], "businessId string, score double, extra string, lat string")
    out = schemas.conform(df, schemas.COMPANY, schemas.COMPANY_ALIASES, keep_extra=True).first()
    assert out["business_id"] == "7" and out["score"] is None and out["lat"] is None and out["extra"] == "x" and out["hide_flag"] is None


def test_company_run_wires_everything(rows):
    registry = rows(
        REGISTRY,
        [
            {"ord": 1, "businessId": "a", "name": "Data Oy", "addresses": [("K 1", "15100", "Lahti")], "mainBusinessLine": ("62",)},
            {"ord": 2, "businessId": "a", "name": "Data Oy copy", "addresses": [("K 1", "15100", "Lahti")], "mainBusinessLine": ("62",)},
            {"ord": 3, "businessId": "b", "name": "As Oy Talo", "addresses": [("K 2", "15100", "Lahti")]},
        ],
    )
    cache = rows("address string, lat double, lon double, ts string", [{"address": "K 1, 15100, Lahti", "lat": 61.0, "lon": 25.6, "ts": "1"}])
    stations = rows("ord long, station_name string, lat double, lon double", [{"ord": 0, "station_name": "Lahti", "lat": 61.0, "lon": 25.6}])
    activity = rows(
        "business_id string, job_count_total long, job_count_last_30d long, job_count_new_since_last long, recruiting_active boolean, tag_count_data long, tag_count_it_support long, tag_count_salesforce long, tag_count_oppisopimus long",
        [],
    )
    kept, excluded = runs.company_run(registry, stations, cache, activity, radius_km=1.0, allow=["62"])
    k = kept.collect()
    assert [(r["business_id"], r["name"], r["nearest_station"], r["score"]) for r in k] == [("a", "Data Oy", "Lahti", 6)]
    assert [r["excluded_reason"] for r in excluded.collect()] == ["name_match:housing"]
    assert rules.SCORE_WEIGHTS["loc_ok"] + rules.SCORE_WEIGHTS["industry_ok"] == 6
