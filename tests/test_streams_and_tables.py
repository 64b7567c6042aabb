import json
import random

import pytest
from pyspark.sql import functions as F

from hireatlas import schemas
from hireatlas.operators import crawl, jobs as J
from hireatlas.session import materialize, shared_dir
from hireatlas.sources import readers as R, writers as W
from hireatlas.streaming import streams as S

JOB = "ord long, company_business_id string, company_domain string, job_title string, job_url string, location_text string, posted_date string, tags array<string>, ts timestamp"


def jobs(spark, numbers, ts="2024-01-01 00:00:00"):
    data = [(i, "1", "a.fi", f"Job {i}", f"https://a.fi/{i}", "Lahti", "2024-01-01", ["data"]) for i in numbers]
    return spark.createDataFrame(data, JOB.rsplit(",", 1)[0]).withColumn("ts", F.lit(ts).cast("timestamp"))


def drain(writer, checkpoint):
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    query.stop()


def parts(df, path, spark):
    """Write a frame as one more file of a stream source."""
    df.coalesce(1).write.mode("append").parquet(path)


def test_new_jobs_stream_equals_the_batch_comparison(spark, folder):
    src, state, out, cp = folder("src"), folder("state"), folder("out"), folder("cp")
    parts(jobs(spark, range(0, 6)), src, spark)
    stream = lambda: spark.readStream.schema(jobs(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(src)
    drain(S.new_jobs_stream(stream(), state, out), cp)
    parts(jobs(spark, range(3, 9)), src, spark)
    drain(S.new_jobs_stream(stream(), state, out), cp)
    new = {(r["batch"], r["ord"]) for r in spark.read.parquet(out).where("is_new").collect()}
    assert {o for b, o in new if b == 0} == set(range(6)) and {o for b, o in new if b == 1} == {6, 7, 8}
    assert J.new_jobs(jobs(spark, range(9)), spark.read.parquet(state)).count() == 0


def test_distinct_jobs_stream_drops_repeats(spark, folder):
    src, out, cp = folder("src"), folder("out"), folder("cp")
    parts(jobs(spark, [1, 1, 2]), src, spark)
    parts(jobs(spark, [2, 3]), src, spark)
    df = spark.readStream.schema(jobs(spark, []).schema).parquet(src)
    drain(S.distinct_jobs_stream(df, "ts", "1 day").writeStream.format("parquet").option("path", out).outputMode("append"), cp)
    assert sorted(r["ord"] for r in spark.read.parquet(out).collect()) == [1, 2, 3]


def test_sliding_activity_stream_equals_batch(spark, folder):
    rng = random.Random(3)
    data = [(i, i % 3, f"2024-01-{rng.randint(1, 28):02d} 10:00:00") for i in range(60)]
    events = spark.createDataFrame(data, "id long, user long, t string").select("id", "user", F.col("t").cast("timestamp").alias("ts"))
    src, cp = folder("src"), folder("cp")
    parts(events, src, spark)
    df = S.sliding_activity(spark.readStream.schema(events.schema).parquet(src), "user", "ts", "0 days", "7 days", "1 day")
    drain(df.writeStream.format("memory").queryName("sliding").outputMode("complete"), cp)
    streamed = {(r["user"], str(r["window"]["start"].date()), r["n_events"]) for r in spark.sql("select * from sliding").collect()}
    batch = {(r["user"], str(r["window_start"]), r["n_events"]) for r in S.sliding_activity_batch(events, "user", "ts", 7).collect()}
    assert streamed == batch


LOG = "domain string, seq long, url string, status_code int, error string, jobs long, skipped_reason string, extractor string"


def log(spark, low, high):
    data = [(f"d{i % 4}", i, f"u{i}", 200, "timeout" if i % 5 == 0 else ("robots_disallow_url" if i % 7 == 0 else None), int(i % 11 == 0), None, "jsonld" if i % 2 else None) for i in range(low, high)]
    return spark.createDataFrame(data, LOG)


def test_crawl_stats_stream_equals_batch(spark, folder):
    src, out, state, cp = folder("src"), folder("out"), folder("state"), folder("cp")
    stream = lambda: spark.readStream.schema(log(spark, 0, 1).schema).parquet(src)
    parts(log(spark, 0, 30), src, spark)
    drain(S.crawl_stats_stream(stream(), out, state), cp)
    parts(log(spark, 30, 47), src, spark)
    drain(S.crawl_stats_stream(stream(), out, state), cp)
    got = {r["domain"]: r for r in spark.read.parquet(f"{out}/batch=1").collect()}
    want = {r["domain"]: r for r in crawl.crawl_stats(log(spark, 0, 47)).collect()}
    assert got == want
    cp2 = folder("cp")
    drain(S.crawl_totals_stream(stream()).writeStream.format("memory").queryName("totals").outputMode("complete"), cp2)
    totals = {r["domain"]: (r["pages_fetched"], r["jobs_found"], r["errors_count"]) for r in spark.sql("select * from totals").collect()}
    assert totals == {d: (r["pages_fetched"], r["jobs_found"], r["errors_count"]) for d, r in want.items()}


def test_overlay_stream_publishes_versions(spark, folder):
    ddl = "business_id string, status string, hide_flag boolean, note string, industry_override string, tags_add string, tags_remove string, seq long"
    src, base, cp = folder("src"), folder("overlay"), folder("cp")
    stream = lambda: spark.readStream.schema(spark.createDataFrame([], ddl).schema).parquet(src)
    parts(spark.createDataFrame([("1", "neutral", None, None, None, "a", None, 1), ("1", "shortlist", None, None, None, "B;a", None, 2)], ddl), src, spark)
    drain(S.overlay_stream(stream(), base, source_master="m", updated_by="me"), cp)
    parts(spark.createDataFrame([("2", "excluded", True, None, None, None, None, 3)], ddl), src, spark)
    drain(S.overlay_stream(stream(), base, source_master="m", updated_by="me"), cp)
    assert R.latest_version(spark, base) == 2
    out = {r["business_id"]: (r["status"], r["tags_add"]) for r in R.read_overlay(spark, base).collect()}
    assert out == {"1": ("shortlist", "b;a"), "2": ("excluded", "")}
    assert W.restore_overlay(spark, base, 1) == 3
    assert R.read_overlay(spark, base).count() == 1


def test_tables_round_trip(spark, folder, tmp_path):
    csv = tmp_path / "companies.csv"
    csv.write_text("businessId,company_name,score,website.url\n0123456-7,Äiti Oy,3,https://a.fi\n0000001-1,\"B, Oy\",,\n", encoding="utf-8")
    df = R.read_companies(spark, str(csv)).orderBy("business_id")
    assert [(r["business_id"], r["name"], r["score"], r["website_url"]) for r in df.collect()] == [("0000001-1", "B, Oy", None, None), ("0123456-7", "Äiti Oy", 3.0, "https://a.fi")]
    with pytest.raises(ValueError):
        R.read_companies(spark, "x.xlsx")
    base = folder("master")
    written = W.write_tables({"Shortlist": df, "Excluded": None}, base, "20240101")
    assert len(written) == 1 and R.read_companies(spark, f"{base}/Shortlist").count() == 2
    W.write_tables({"Shortlist": df.limit(1)}, base, "20240202")
    newest = R.latest_rows(spark.read.parquet(f"{base}/Shortlist"), "run_date")
    assert newest.count() == 1
    assert R.read_crawl_stats(spark, folder("nothing")) is None


def test_job_files_keep_tags_as_arrays(spark, folder):
    path = folder("jobs") + ".jsonl"
    W.write_jobs(jobs(spark, [1, 2]), path)
    back = R.read_jobs(spark, path)
    assert back.columns == schemas.JOB.fieldNames()
    assert back.first()["tags"] == ["data"] and back.first()["employment_type"] is None


def test_domain_map_stations_places_and_employees(spark, tmp_path):
    (tmp_path / "d.csv").write_text("business_id,name,domain\n0123456-7,A,https://a.fi/x\n,B,b.fi\n1,C,nan\n", encoding="utf-8")
    assert [(r["business_id"], r["domain"]) for r in R.read_domain_map(spark, str(tmp_path / "d.csv")).collect()] == [("0123456-7", "a.fi")]
    (tmp_path / "s.csv").write_text("name;latitude;longitude;country\nLahti;60.9;25.6;FI\nRiga;56.9;24.1;LV\nNowhere;;;FI\n", encoding="utf-8")
    assert [(r["station_name"], r["lat"]) for r in R.read_stations(spark, str(tmp_path / "s.csv")).collect()] == [("Lahti", 60.9)]
    (tmp_path / "s2.csv").write_text("station_name,lat,lon\nX,1,2\nY,3,4\n", encoding="utf-8")
    assert R.read_stations(spark, str(tmp_path / "s2.csv")).count() == 2
    (tmp_path / "p.csv").write_text("place_id,name,formatted_address,lat,lon\np1,N,\"A, Lahti\",60.9,25.6\n", encoding="utf-8")
    (df, name, lat, _), = R.read_places(spark, [f"Lahti, 60.98, 25.66, {tmp_path / 'p.csv'}"])
    assert (name, lat, df.count()) == ("Lahti", 60.98, 1)
    with pytest.raises(ValueError):
        R.read_places(spark, ["Lahti,60,25"])
    (tmp_path / "bad.csv").write_text("place_id,name\n1,x\n", encoding="utf-8")
    with pytest.raises(ValueError):
        R.read_places(spark, [f"L,1,2,{tmp_path / 'bad.csv'}"])
    (tmp_path / "e.csv").write_text(" businessId , employee_count ,employee_band\n1,12,10-49\n", encoding="utf-8")
    assert R.read_employees(spark, str(tmp_path / "e.csv")).first()["employee_count"] == 12


def test_rules_text():
    assert R.parse_rules(None) == {"other": []} and R.parse_rules("[1]") == {"other": []}
    assert R.parse_rules('{"it": {"prefixes": ["62"]}, "x": ["1"], "other": null}') == {"it": ["62"], "x": ["1"], "other": []}


def test_audit_is_tolerant_and_newest_first(spark, folder, tmp_path):
    path = folder("audit")
    for n in (1, 2, 3):
        W.append_audit(spark.createDataFrame([(f"2024-01-0{n}", f"b{n}", n)], "ts string, batch_id string, changed_rows long"), path)
    (tmp_path / path.split("/")[-1] / "bad.json").write_text("not json\n", encoding="utf-8")
    assert [r["batch_id"] for r in R.read_audit(spark, path, 2).collect()] == ["b3", "b2"]


def test_snapshot_dates(spark):
    paths = ["/out/master_20240101.parquet", "/out/run_20240202/jobs/diff.parquet", "/out/run_20240303/x.parquet", "/out/master.parquet"]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p string")
    assert [r["d"] for r in df.orderBy("i").select(R.snapshot_date(F.col("p")).alias("d")).collect()] == ["20240101", "20240202", "20240303", None]


def test_newest_snapshot_by_date_then_time(spark):
    files = spark.sql("SELECT * FROM VALUES ('/o/master_20240101.csv', timestamp'2025-01-01'), ('/o/master_20240301.csv', timestamp'2024-01-01'), ('/o/master.csv', timestamp'2026-01-01') t(path, modificationTime)")
    assert R.newest_snapshot(files).first()["path"] == "/o/master_20240301.csv"
    assert R.newest_snapshot(files.where("path = '/o/master.csv'")).first()["path"] == "/o/master.csv"


def test_a_half_written_version_is_not_read(spark, folder):
    base = folder("table")
    assert R.latest_version(spark, base) is None
    assert W.publish_version(spark.range(3), base) == 1
    spark.range(9).write.parquet(f"{base}/version=2")
    assert R.latest_version(spark, base) == 1


def test_labelled_pages_and_golden_texts(spark, tmp_path):
    (tmp_path / "labels.json").write_text(json.dumps([{"file": "a.html", "label": "YES"}, {"file": "", "label": "no"}, {"file": "b.html", "label": "no"}]), encoding="utf-8")
    pages = tmp_path / "pages"
    pages.mkdir()
    (pages / "a.html").write_text("<p>one\ntwo</p>", encoding="utf-8")
    (pages / "b.html").write_text("<p>b</p>", encoding="utf-8")
    got = {r["url"]: (r["label"], r["html"]) for r in R.read_labelled_pages(spark, str(tmp_path / "labels.json"), str(pages)).collect()}
    assert got == {"https://example.com/a.html": ("yes", "<p>one\ntwo</p>"), "https://example.com/b.html": ("no", "<p>b</p>")}
    (tmp_path / "g.jsonl").write_text('{"id":"1","url":"u","text":"hello","label":"Yes"}\n', encoding="utf-8")
    assert R.read_golden_texts(spark, str(tmp_path / "g.jsonl")).first()["html"] == "<html><body>hello</body></html>"


def test_signal_rows_and_outreach(spark, folder, rows):
    df = rows("business_id string, evidence_snippets array<string>, evidence_urls array<string>", [{"business_id": "1", "evidence_snippets": ['say "hi"', "b"], "evidence_urls": []}])
    path = folder("signal")
    W.write_signal_rows(df, path)
    back = spark.read.option("header", True).option("escape", '"').csv(path).first()
    assert json.loads(back["evidence_snippets"]) == ['say "hi"', "b"] and back["evidence_urls"] == "[]"
    W.write_signal_rows(df, path + "j", "jsonl")
    assert spark.read.json(path + "j").first()["evidence_snippets"] == ['say "hi"', "b"]
    view = rows("business_id string, name string, secret string, score double", [{"business_id": "1", "name": "A", "secret": "x", "score": 1.0}])
    out = W.outreach(view, {"master": "m", "filters": "None", "diff": None})
    assert out["outreach"].columns == ["business_id", "name", "score"] and out["meta"].first()["diff"] is None
    geo = rows("business_id string, lat double, lon double", [{"business_id": "1", "lat": 60.5, "lon": 25.0}, {"business_id": "2"}])
    assert [json.loads(r["value"]) for r in W.geojson_features(geo).collect()] == [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [25.0, 60.5]}, "properties": {"business_id": "1", "lat": 60.5, "lon": 25.0}}]


def test_shared_folder_comes_from_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark, "x").startswith(base)
    assert materialize(spark.range(5), "five").count() == 5
