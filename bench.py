"""Wall seconds of the headline queries on one local session; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from hireatlas.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "station_summary", "industry_summary", "tag_summary", "top_companies", "kpi", "nearest_station", "radius_join", "company_score",
    "effective_filter", "explain_filter", "preset_counts", "dedup_companies", "overlay_upsert", "edit_diff", "dedup_jobs", "jobs_diff",
    "company_activity", "watch_list", "crawl_stats", "activity_sliding", "page_text", "page_links", "cookie_wall",
    "page_verdict", "generic_jobs", "hiring_signal", "company_package", "snippets", "detect_tags", "feed_jobs", "places_master",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        # Each test table is one row group, which one task reads; the rows are dealt to all cores.
        .config("hireatlas.input.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    for name in ("page_text", "station_summary"):  # warm-up, not counted
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        # Every row and column is produced, and nothing is brought to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_wall", "value": total, "unit": "sec", "queries": seconds, "sf": sf}))


if __name__ == "__main__":
    main()
