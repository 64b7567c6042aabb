"""Purging days beside running readers, broken lines, transliteration."""

import datetime
import json
import os

from pyspark.sql import functions as F

from hireatlas.functions import text as T
from hireatlas.sources import lines as L, readers as R, retention as P

DAY = datetime.date


def days(spark, *numbers):
    return spark.createDataFrame([(n, f"2024-01-{n:02d} 10:00:00") for n in numbers], "id int, t string").select("id", F.col("t").cast("timestamp").alias("ts"))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_purge_is_a_commit_that_readers_see_when_they_start(spark, folder):
    base = folder("runs")
    assert P.read_days(spark, base) is None and P.first_day(spark, base) is None and P.purge(spark, f"{base}-none", DAY(2024, 1, 9), 1) == []
    P.append_days(days(spark, 1, 5, 10, 20), base, "ts")
    P.append_days(spark.createDataFrame([(99, None)], "id int, ts timestamp"), base, "ts")
    before = P.read_days(spark, base)
    assert ids(before) == [1, 5, 10, 20, 99]
    assert P.purge(spark, base, DAY(2024, 1, 30), 22) == [DAY(2024, 1, 1), DAY(2024, 1, 5)]
    # A reader that was planned before still finds its files; a new one never opens those of purged days.
    assert ids(before) == [1, 5, 10, 20, 99]
    with open(f"{base}/day=2024-01-01/part-broken.parquet", "wb") as f:
        f.write(b"no parquet")
    assert ids(P.read_days(spark, base)) == [10, 20, 99]
    files = P.read_days(spark, base).select(F.col("_metadata.file_path")).distinct().collect()
    assert not any("2024-01-0" in r[0] for r in files)
    # Purged days do not come back by a purge with a longer age, nor by late rows.
    assert P.purge(spark, base, DAY(2024, 1, 30), 300) == [] and P.first_day(spark, base) == DAY(2024, 1, 8)
    P.append_days(days(spark, 2, 21), base, "ts")
    assert ids(P.read_days(spark, base)) == [10, 20, 21, 99]
    assert P.vacuum(spark, base, datetime.timedelta(days=1)) == [] and os.path.exists(f"{base}/day=2024-01-01")
    assert P.vacuum(spark, base, datetime.timedelta(0)) == [DAY(2024, 1, 1), DAY(2024, 1, 2), DAY(2024, 1, 5)]
    assert not os.path.exists(f"{base}/day=2024-01-01") and ids(P.read_days(spark, base)) == [10, 20, 21, 99]


def test_broken_lines_are_set_aside(spark, folder, tmp_path):
    good = [{"ts": "2024-01-01", "batch_id": "a", "changed_rows": 1}, {"ts": "2024-01-03", "batch_id": "b"}, {"batch_id": "c", "more": {"x": 1}}, {}]
    bad = ["not json", '{"ts": "2024', '{"ts": "x", "changed_rows": "many"}', "[1]", '"text"', "null"]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "one.jsonl").write_text("\n".join([json.dumps(g) for g in good] + bad + ["", "  "]) + "\n", encoding="utf-8")
    (tmp_path / "log" / "two.jsonl").write_text('{"ts": "2024-01-02", "batch_id": "d"}\n{"broken\n', encoding="utf-8")
    aside = folder("quarantine")
    got = R.read_audit(spark, str(tmp_path / "log"), 10, aside)
    assert [r.batch_id for r in got.collect()] == ["b", "d", "a", "c", None]
    lines = spark.read.parquet(aside)
    assert sorted(r.line for r in lines.collect()) == sorted([*bad, '{"broken'])
    counts = {(os.path.basename(r.file), r.reason): r.n_lines for r in L.bad_line_counts(lines).collect()}
    assert counts == {("one.jsonl", "no JSON object"): 5, ("one.jsonl", "value of another type"): 1, ("two.jsonl", "no JSON object"): 1}
    assert R.read_audit(spark, str(tmp_path / "log"), 10).count() == 5


TEXTS = {
    "Äänekoski, Jyväskylä": "Aanekoski, Jyvaskyla",
    "Straße Ærø Łódź Þór": "Strasse AEro Lodz Thor",
    "Αθήνα Θεσσαλονίκη Ψυχή": "Athena Thessalonike Psukhe",
    "Щёлково Юрьев Ижевск": "Shchiolkovo Iur'ev Izhevsk",
    "Київ Їжак": "Kiyiv Yizhak",
    "Ｆｕｌｌ ﬁne “quoted” – 5 €…": 'Full fine "quoted" - 5 EUR...',
    "№ 5 ™ K": "No 5 (tm) K",
    "ἀρχή": "arkhe",
    "東京 plain": "東京 plain",
    "plain": "plain",
    "": "",
}


def test_scripts_become_ascii(spark):
    df = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string")
    got = {r.t: r.a for r in df.select("t", T.to_ascii(F.col("t")).alias("a")).collect()}
    assert got == {**TEXTS, None: None}
