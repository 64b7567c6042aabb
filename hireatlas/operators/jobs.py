"""Job postings: fingerprint, duplicates, what is new since the last run, activity per company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hireatlas.functions.text import strip
from hireatlas.functions.values import posted_ts
from hireatlas.operators.companies import first_per_key
from hireatlas.rules import ACTIVITY_TAGS

_FINGERPRINT_FIELDS = ["job_title", "location_text", "posted_date", "company_domain"]
COMPANY_COLUMNS = ["business_id", "name", "nearest_station", "distance_km", "score", "industry_effective", "status"]


def _normal(c: str) -> Column:
    text = F.regexp_replace(strip(F.lower(F.coalesce(F.col(c), F.lit("")))), r"\s+", " ")
    return F.replace(F.replace(text, F.lit(", finland"), F.lit("")), F.lit(", suomi"), F.lit(""))


def fingerprint() -> Column:
    """Hash of title, place, date and domain that stays the same from run to run."""
    return F.md5(F.concat_ws("\u0001", *[_normal(c) for c in _FINGERPRINT_FIELDS]))


def dedup_jobs(jobs: DataFrame) -> DataFrame:
    """First posting per URL, then the first per company and fingerprint, by ingest order."""
    by_url = first_per_key(jobs, ["job_url"], [F.col("ord")]).withColumn("job_fingerprint", fingerprint())
    return first_per_key(by_url, ["company_business_id", "job_fingerprint"], [F.col("ord")])


def flag_new(jobs: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct postings with ``is_new``: neither the URL nor the fingerprint was there last time."""
    urls = known.where("job_url IS NOT NULL").select("job_url").distinct().withColumn("_known_url", F.lit(True))
    prints = known.where("job_fingerprint IS NOT NULL").select("job_fingerprint").distinct().withColumn("_known_print", F.lit(True))
    flagged = dedup_jobs(jobs).join(urls, "job_url", "left").join(prints, "job_fingerprint", "left")
    return flagged.withColumn("is_new", F.col("_known_url").isNull() & F.col("_known_print").isNull()).drop("_known_url", "_known_print")


def new_jobs(jobs: DataFrame, known: DataFrame) -> DataFrame:
    """Only the new postings, by two anti joins."""
    return (
        dedup_jobs(jobs)
        .join(known.where("job_url IS NOT NULL").select("job_url"), "job_url", "left_anti")
        .join(known.where("job_fingerprint IS NOT NULL").select("job_fingerprint"), "job_fingerprint", "left_anti")
    )


def next_state(jobs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """State for the next run: the current postings, plus the older ones when ``known`` is given."""
    current = jobs.select("job_url", "job_fingerprint")
    return current if known is None else current.unionByName(known.select("job_url", "job_fingerprint")).distinct()


def company_activity(jobs: DataFrame, as_of: Column, tags: list[str] = ACTIVITY_TAGS, days: int = 30) -> DataFrame:
    """Posting counts per company: all, recent, new, and per tag."""
    recent = posted_ts("posted_date") >= as_of - F.make_dt_interval(F.lit(days))
    fresh = F.col("is_new") if "is_new" in jobs.columns else F.lit(False)
    return (
        jobs.where("company_business_id IS NOT NULL")
        .groupBy(F.col("company_business_id").alias("business_id"))
        .agg(
            F.count("*").alias("job_count_total"),
            F.count_if(recent).alias("job_count_last_30d"),
            F.count_if(fresh).alias("job_count_new_since_last"),
            (F.count("*") > 0).alias("recruiting_active"),
            *[F.count_if(F.array_contains("tags", t)).alias(f"tag_count_{t}") for t in tags],
        )
    )


def with_company(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Postings with the company attributes; a name that is already taken gets ``_company``."""
    wanted = [c for c in COMPANY_COLUMNS if c in companies.columns]
    renamed = [F.col(c).alias(f"{c}_company" if c in jobs.columns else c) for c in wanted if c != "business_id"]
    side = companies.select(F.col("business_id").alias("company_business_id"), *renamed, F.col("business_id").alias("_id"))
    joined = jobs.join(side, "company_business_id", "left")
    return joined.withColumnRenamed("_id", "business_id_company" if "business_id" in jobs.columns else "business_id")
