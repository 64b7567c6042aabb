"""Whole runs: registry to shortlist, and postings to activity, state and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hireatlas import rules
from hireatlas.functions.text import filled
from hireatlas.operators import analytics, companies as C, jobs as J
from hireatlas.operators.nearby import nearest_station
from hireatlas.session import materialize
from hireatlas.sources.writers import publish_known_jobs, write_tables


def geocode_hits(companies: DataFrame, cache: DataFrame, address: str = "full_address") -> DataFrame:
    """Coordinates from the cache; ``provider`` tells the hits. Rows keep coordinates they have."""
    one = cache_latest(cache).select(F.col("address").alias(address), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    joined = companies.join(one, address, "left")
    return joined.withColumns(
        {
            "lat": F.coalesce("lat", "_lat") if "lat" in companies.columns else F.col("_lat"),
            "lon": F.coalesce("lon", "_lon") if "lon" in companies.columns else F.col("_lon"),
            "provider": F.when(F.col("_lat").isNotNull(), F.lit("cache")),
        }
    ).drop("_lat", "_lon")


def geocode_misses(companies: DataFrame, cache: DataFrame, address: str = "full_address") -> DataFrame:
    """Distinct addresses the cache does not hold: the work list of a provider."""
    wanted = companies.where(filled(address).isNotNull()).select(F.col(address).alias("address")).distinct()
    return wanted.join(cache.select("address"), "address", "left_anti")


def cache_latest(cache: DataFrame) -> DataFrame:
    """One cache entry per address, the newest one."""
    return cache.groupBy("address").agg(F.max_by(F.struct("lat", "lon", "ts"), "ts").alias("c")).select("address", "c.*")


def cache_merge(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """Cache with a provider's answers; answers without coordinates are not stored."""
    columns = ["address", "lat", "lon", "ts"]
    found = answers.where("lat IS NOT NULL AND lon IS NOT NULL")
    return cache_latest(cache.select(*columns).unionByName(found.select(*columns)))


def company_run(
    registry: DataFrame,
    stations: DataFrame,
    cache: DataFrame,
    activity: DataFrame,
    *,
    radius_km: float = 1.0,
    allow: list[str] | None = None,
    deny: list[str] | None = None,
    groups: dict[str, list[str]] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Registry rows to scored shortlist and excluded rows.

    Coordinates are attached before duplicates are dropped, so that a geocoded copy wins. ``registry``
    carries ``ord``, the ingest order.
    """
    shaped = C.normalize_registry(registry, groups or rules.INDUSTRY_GROUPS)
    located = nearest_station(C.deduplicate(geocode_hits(shaped, cache)), stations)
    scored = C.score_companies(located, activity, radius_km=radius_km, allow=allow or [], deny=deny or [], line="industry_raw")
    kept = F.col("excluded_reason").isNull()
    return scored.where(kept), scored.where(~kept)


def publish_company_run(shortlist: DataFrame, excluded: DataFrame, base: str, run_date: str) -> list[str]:
    """Write both sides of a company run, one ``run_date`` partition per table."""
    return write_tables({"Shortlist": shortlist, "Excluded": excluded}, base, run_date)


def jobs_run(jobs: DataFrame, known: DataFrame, as_of: Column) -> dict[str, DataFrame | Column]:
    """All postings with their flag, the new ones, and the activity, counted after the comparison."""
    flagged = J.flag_new(jobs, known)
    return {"jobs_all": flagged, "jobs_new": flagged.where("is_new"), "activity": J.company_activity(flagged, as_of), "as_of": as_of}


def publish_jobs_run(
    run: dict[str, DataFrame | Column], base: str, run_date: str, *, shortlist: DataFrame | None = None, excluded: DataFrame | None = None,
    crawl_stats: DataFrame | None = None, keep_history: DataFrame | None = None,
) -> list[str]:
    """Write the run's tables, then the state the next run compares with.

    The flagged postings are written once and read back for the rest, so nothing is computed twice. ``activity`` of the run
    is replaced by the same counts over the stored postings, which need the run's ``as_of``.
    """
    spark = run["jobs_all"].sparkSession
    written = write_tables({"Jobs_All": run["jobs_all"]}, base, run_date)
    stored = spark.read.parquet(written[0])
    written += write_tables(
        {
            "Shortlist": shortlist, "Excluded": excluded, "Jobs_New": stored.where("is_new"), "Crawl_Stats": crawl_stats,
            "Company_Activity": J.company_activity(stored, run["as_of"]) if "as_of" in run else run["activity"],
        },
        base,
        run_date,
    )
    publish_known_jobs(J.next_state(stored, keep_history), f"{base}/known_jobs")
    return written


def analytics_bundle(shortlist: DataFrame, new_jobs: DataFrame, all_jobs: DataFrame, stats: DataFrame | None) -> dict[str, DataFrame]:
    """The summary tables of a run, by table name.

    All of them read the same rows, so those are stored first where they are not a stored table yet.
    """
    shortlist, new_jobs = materialize(shortlist, "shortlist"), materialize(new_jobs, "new-jobs")
    return {
        "KPI": analytics.kpi(new_jobs, shortlist, stats),
        "Stations": analytics.station_summary(shortlist, new_jobs),
        "Tags_New": analytics.tag_summary(new_jobs, shortlist),
        "Tags_All": analytics.tag_summary(all_jobs, shortlist),
        "Top_Companies": analytics.top_companies(shortlist, new_jobs, all_jobs),
        "Industry_Summary": analytics.industry_summary(shortlist, new_jobs),
    }
