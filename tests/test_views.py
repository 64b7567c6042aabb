from pyspark.sql import functions as F

from hireatlas.operators import filters as L, overlay as O

VIEW = "ord long, business_id string, name string, industry_effective string, city string, _source_city string, score double, distance_km double, nearest_station string, recruiting_active boolean, hide_flag boolean, excluded_reason string, status string, tags_effective array<string>, website_url string, note string"
OVERLAY = "business_id string, status string, hide_flag boolean, note string, industry_override string, tags_add string, tags_remove string, updated_at string, updated_by string, source_master string"


def view(rows):
    base = {"hide_flag": False, "excluded_reason": None, "status": "neutral", "recruiting_active": False, "tags_effective": []}
    return rows(
        VIEW,
        [
            base | {"ord": 1, "business_id": "1", "name": "As Oy Talo", "score": 9.0, "distance_km": 0.1},
            base | {"ord": 2, "business_id": "2", "name": "Data Oy", "industry_effective": "it", "city": "Mäntsälä", "score": 5.0, "distance_km": 0.5, "nearest_station": "Lahti", "recruiting_active": True, "tags_effective": ["data", "ml"], "website_url": "https://Data.fi"},
            base | {"ord": 3, "business_id": "3", "name": "Far Oy", "industry_effective": "other", "city": "Turku", "_source_city": "MANTSALA", "score": None, "distance_km": 9.0, "nearest_station": "Turku", "tags_effective": ["sales"], "note": "call DATA team"},
            base | {"ord": 4, "business_id": "4", "name": "Hidden Oy", "hide_flag": True, "score": 1.0, "excluded_reason": ""},
            base | {"ord": 5, "business_id": "5", "name": "Out Oy", "excluded_reason": "company_form:X", "score": 1.0, "status": "excluded", "tags_effective": None},
        ],
    )


def ids(df):
    return sorted(r["business_id"] for r in df.collect())


def test_filter_options_one_by_one(rows):
    df = view(rows)
    spec = L.FilterSpec
    assert ids(L.apply_filter(df, spec())) == ["2", "3"]
    assert ids(L.apply_filter(df, spec(include_housing=True, include_hidden=True, include_excluded=True))) == ["1", "2", "3", "4", "5"]
    assert ids(L.apply_filter(df, spec(min_score=1))) == ["2"]
    assert ids(L.apply_filter(df, spec(max_distance_km=1.0))) == ["2"]
    assert ids(L.apply_filter(df, spec(cities=["mäntsälä "]))) == ["2", "3"]
    assert ids(L.apply_filter(df, spec(stations=["Turku"]))) == ["3"]
    assert ids(L.apply_filter(df, spec(only_recruiting=True))) == ["2"]
    assert ids(L.apply_filter(df, spec(include_tags=[" DATA "]))) == ["2"]
    assert ids(L.apply_filter(df, spec(exclude_tags=["ml"], include_excluded=True))) == ["3", "5"]
    assert ids(L.apply_filter(df, spec(search="data"))) == ["2", "3"]
    assert ids(L.apply_filter(df, spec(focus_business_id="3"))) == ["3"]
    assert ids(L.apply_filter(df, spec(industries=["other"]))) == ["3"]
    assert ids(L.apply_filter(df, spec(statuses=["excluded"], include_excluded=True))) == ["5"]


def test_explain_agrees_with_the_filter(rows):
    df = view(rows)
    spec = L.FilterSpec(min_score=3, cities=["Mantsala"], include_tags=["data"], only_recruiting=True, statuses=["neutral"])
    out = {r["business_id"]: r for r in L.explain_filter(df, spec).collect()}
    assert {k for k, r in out.items() if r["passes"]} == set(ids(L.apply_filter(df, spec)))
    assert out["2"]["reasons"] == ["status:neutral", "city:Mäntsälä", "min_score", "recruiting_active", "include_tags"]
    assert out["1"]["fails"] == ["housing_name", "city", "only_recruiting", "include_tags"]
    assert out["4"]["fails"] == ["hidden", "city", "min_score", "only_recruiting", "include_tags"]


def test_absent_columns_add_no_condition(rows):
    df = rows("business_id string", [{"business_id": "1"}])
    assert ids(L.apply_filter(df, L.FilterSpec(min_score=5, stations=["x"], include_tags=["t"], cities=["y"]))) == ["1"]


def test_profiles_presets_and_descriptions():
    assert L.with_profile("data_junior", {"min_score": 7, "max_items": None, "include_tags": ""}) == {
        "include_tags": "data", "exclude_tags": "senior,lead,principal", "min_score": 7, "max_items": 50,
    }
    assert L.with_profile("unknown", {"a": None}) == {"a": None}
    assert L.preset("Recruiting").only_recruiting and L.preset("nope") == L.preset("Default")
    assert L.csv_list("Lahti, lahti , Turku,,") == ["Lahti", "Turku"]
    spec = L.spec_from_options({"include_tags": "data, ai", "min_score": 5, "max_items": 3})
    assert spec.include_tags == ["data", "ai"]
    assert L.describe(spec) == ["Min score: 5", "Include tags: data, ai"]
    assert L.describe(L.FilterSpec()) == ["None"]


def test_preset_counts_match_the_presets(rows):
    df = view(rows)
    got = {r["preset"]: r["n_rows"] for r in L.preset_counts(df).collect()}
    assert got == {name: L.apply_filter(df, L.preset(name)).count() for name in got}
    assert len(got) == 6


def test_neighbours_across_ranges(spark):
    df = spark.createDataFrame([(i * 3, f"b{i}") for i in range(50)], "ord long, business_id string").repartition(5)
    out = {r["business_id"]: (r["prev_id"], r["next_id"]) for r in L.neighbours(df, [F.col("ord").asc()], "business_id").collect()}
    assert out == {f"b{i}": (f"b{i - 1}" if i else None, f"b{i + 1}" if i < 49 else None) for i in range(50)}


def test_neighbours_work_their_rows_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("long")
    def counted(i):
        seen.add(1)
        return -i

    df = spark.range(200).repartition(3).select(F.concat(F.lit("b"), "id").alias("business_id"), counted("id").alias("score"))
    assert L.neighbours(df, [F.col("score").asc()], "business_id").count() == 200
    assert seen.value == 200


def test_overlay_applies_values_and_tags(rows):
    master = rows("business_id string, name string, industry string, tags string, status string", [{"business_id": "1", "name": "A", "industry": "it", "tags": "Data;x", "status": "neutral"}, {"business_id": "2", "name": "B", "industry": "other", "tags": None, "status": "neutral"}])
    edits = rows(
        OVERLAY,
        [
            {"business_id": "1", "status": "shortlist", "industry_override": "marketing", "tags_add": "ML, ai", "tags_remove": "X", "updated_at": "2"},
            {"business_id": "1", "status": "excluded", "updated_at": "1"},
            {"business_id": "9", "status": "shortlist"},
        ],
    )
    out = {r["business_id"]: r for r in O.apply_overlay(master, edits).collect()}
    assert len(out) == 2
    assert out["1"]["status"] == "shortlist" and out["1"]["industry_effective"] == "marketing" and out["1"]["tags_effective"] == ["ai", "data", "ml"]
    assert out["2"]["status"] == "neutral" and out["2"]["hide_flag"] is False and out["2"]["industry_effective"] == "other" and out["2"]["tags_effective"] == []
    again = O.apply_overlay(O.apply_overlay(master, edits).select(*master.columns), edits).orderBy("business_id").select("status", "tags_effective").collect()
    assert again == O.apply_overlay(master, edits).orderBy("business_id").select("status", "tags_effective").collect()


def test_upsert_updates_inserts_and_skips_blank_ids(rows):
    base = rows(OVERLAY, [{"business_id": "1", "status": "neutral", "note": "old", "updated_by": "x", "source_master": "m1"}, {"business_id": "2", "status": "neutral"}])
    edits = rows("business_id string, status string, hide_flag boolean, note string, industry_override string, tags_add string, tags_remove string", [{"business_id": "1", "status": "shortlist", "tags_add": "B, a;b"}, {"business_id": " 3 ", "hide_flag": True}, {"business_id": ""}])
    out = {r["business_id"]: r for r in O.upsert(base, edits, source_master=None, updated_by="me").collect()}
    assert set(out) == {"1", "2", "3"}
    assert (out["1"]["status"], out["1"]["note"], out["1"]["tags_add"], out["1"]["updated_by"], out["1"]["source_master"]) == ("shortlist", None, "b;a", "me", "m1")
    assert out["3"]["hide_flag"] is True and out["2"]["updated_by"] is None


def test_merge_edits_is_a_patch(rows):
    ddl = "business_id string, status string, hide_flag boolean, note string, industry_override string, tags_add string, tags_remove string, present array<string>"
    a = rows(ddl, [{"business_id": "1", "status": "shortlist", "note": "n", "present": ["status", "note"]}, {"business_id": " ", "present": ["status"]}])
    b = rows(ddl, [{"business_id": "1", "status": None, "present": ["status"]}, {"business_id": "2", "note": "z", "present": ["note"]}])
    out = {r["business_id"]: (r["status"], r["note"], r["present"]) for r in O.merge_edits([a, b]).collect()}
    assert out == {"1": (None, "n", ["note", "status"]), "2": (None, "z", ["note"])}


def test_edit_diff(rows):
    before = rows(OVERLAY, [{"business_id": "1", "status": "a", "note": None}, {"business_id": "2", "status": "a"}, {"business_id": "3"}])
    after = rows(OVERLAY, [{"business_id": "1", "status": "b", "note": "x"}, {"business_id": "2", "status": "a"}, {"business_id": "4"}])
    summary = O.edit_diff(before, after).first()
    assert (summary["status"], summary["note"], summary["hide_flag"], summary["changed_rows_count"]) == (1, 1, 0, 1)
    assert [(r["business_id"], r["changed_fields"]) for r in O.edit_diff_rows(before, after).collect()] == [("1", ["status", "note"])]
    assert O.edit_diff(before, before).first()["changed_rows_count"] == 0


def test_view_meta(rows):
    master = rows("business_id string, name string, industry string, score double", [{"business_id": str(i), "name": "n", "score": float(i)} for i in range(5)])
    out = O.view_meta(master, rows(OVERLAY, [{"business_id": "1"}]), L.FilterSpec(min_score=3), "20240101", None).first()
    assert (out["rows_master"], out["rows_curation"], out["rows_filtered"], out["mismatch"], out["active_filters"]) == (5, 1, 2, False, "Min score: 3")


def test_retention_and_values(spark, rows):
    df = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01', 'a'), (timestamp'2024-01-20', 'a') t(ts, kind)")
    out = L.retention_counts(df, "ts", F.lit("2024-01-31").cast("timestamp"), 30, ["kind"]).first()
    assert (out["kept"], out["purged"]) == (2, 0)
    assert L.retained(df, "ts", F.lit("2024-02-05").cast("timestamp"), 30).count() == 1
    got = {(r["kind"], r["value"]) for r in L.filter_values(view(rows)).collect()}
    assert got == {("city", "Mäntsälä"), ("city", "Turku"), ("city", "MANTSALA"), ("industry", "it"), ("industry", "other")}
