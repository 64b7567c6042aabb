"""The registered queries: names, oracle coverage, plan rules, and independence from partitioning."""

import pathlib
import re

import pytest

import __spark_entry__ as entry
from hireatlas.plans.oracles import ORACLES
from hireatlas.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
JOINED = [
    "nearest_station_cells", "radius_join", "company_score", "effective_view_meta", "prev_next", "kpi", "top_companies", "map_layer", "map_bounds",
    "crawl_coverage", "access_gate", "generic_jobs", "career_suggestion", "hiring_signal", "latest_snapshot", "preset_counts",
]
SHAPED = ["station_summary", "tag_summary", "kpi", "dedup_companies", "jobs_diff_flagged", "crawl_stats", "generic_jobs", "hiring_signal", "watch_list", "prev_next"]


def canonical(df):
    columns = sorted(df.columns)
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SHAPED)
def test_results_do_not_depend_on_the_number_of_partitions(spark, name):
    results = []
    try:
        for n in (1, 7):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            results.append(canonical(entry.queries()[name](spark, SF)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert results[0] == results[1] and results[0]


def test_plans_hold_no_cross_join_and_no_row_python(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        for name in JOINED:
            plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", plan), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_the_library_stands_without_the_training_text_operators():
    package = pathlib.Path(entry.__file__).parent / "hireatlas"
    for path in package.rglob("*.py"):
        if "llm" not in path.relative_to(package).parts:
            assert not re.search(r"hireatlas\.llm|from \.+llm|import llm", path.read_text(encoding="utf-8")), path
