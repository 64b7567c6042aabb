"""Summaries by station, tag, industry and company, and the run's key figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from hireatlas.functions.text import usable
from hireatlas.operators.median import grouped_median
from hireatlas.rules import MAP_FALLBACK_CENTER
from hireatlas.session import materialize


def jobs_per_company(jobs: DataFrame) -> DataFrame:
    return (
        jobs.where("company_business_id IS NOT NULL")
        .groupBy(F.col("company_business_id").alias("business_id"))
        .agg(F.count("*").alias("n_jobs"))
    )


def ranked_text(df: DataFrame, keys: list[str], item: str, count: str, k: int | None, form: Column, sep: str, out: str) -> DataFrame:
    """The ``k`` most frequent items per key as one text, ties by item; all of them without ``k``.

    Expects one row per key and item. Leave ``k`` out only where the items are a short, fixed vocabulary.
    """
    order = [F.col(count).desc(), F.col(item).asc()]
    top = df
    if k is not None and keys:
        top = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rn") <= k)
    elif k is not None:
        top = df.orderBy(*order).limit(k)
    entry = F.struct((-F.col(count)).alias("c"), F.col(item).alias("i"), form.alias("t"))
    return top.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("_l")).select(*keys, _joined(sep).alias(out))


def _joined(sep: str) -> Column:
    return F.nullif(F.array_join(F.transform("_l", lambda e: e["t"]), sep), F.lit(""))


def _summary_rows(shortlist: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The narrow rows that counts, medians and lists of a summary share, stored once."""
    return materialize(shortlist.where(F.col(key).isNotNull()).select("business_id", "recruiting_active", key, *columns), "summary-rows")


def _group_summary(shortlist: DataFrame, new_jobs: DataFrame | None, key: str, medians: dict[str, str]) -> DataFrame:
    rows = shortlist
    if new_jobs is None:
        rows = rows.withColumn("n_jobs", F.lit(0).cast("long"))
    else:
        rows = rows.join(jobs_per_company(new_jobs), "business_id", "left")
    counts = rows.groupBy(key).agg(
        F.count("*").alias("companies_total"),
        F.count_if("recruiting_active").alias("_recruiting"),
        F.coalesce(F.sum("n_jobs"), F.lit(0)).cast("long").alias("new_jobs_total"),
    )
    middles = grouped_median(shortlist, [key], medians)
    return counts.join(middles, key, "left")


def station_summary(shortlist: DataFrame, new_jobs: DataFrame | None = None) -> DataFrame:
    """Per station: companies, recruiting companies, new postings, median score and distance."""
    shortlist = _summary_rows(shortlist, "nearest_station", ["score", "distance_km"])
    out = _group_summary(shortlist, new_jobs, "nearest_station", {"median_score": "score", "median_distance_km": "distance_km"})
    return out.select(
        F.col("nearest_station").alias("station"),
        "companies_total",
        F.col("_recruiting").alias("recruiting_active_companies"),
        "new_jobs_total",
        "median_score",
        "median_distance_km",
    ).orderBy(F.col("companies_total").desc(), "station")


def industry_summary(shortlist: DataFrame, new_jobs: DataFrame | None = None) -> DataFrame:
    """Per industry: the same counts, the median distance and the three most frequent stations."""
    shortlist = _summary_rows(shortlist, "industry", ["nearest_station", "distance_km"])
    out = _group_summary(shortlist, new_jobs, "industry", {"median_distance_km": "distance_km"})
    stations = (
        shortlist.where("industry IS NOT NULL AND nearest_station IS NOT NULL")
        .groupBy("industry", "nearest_station")
        .agg(F.count("*").alias("n"))
    )
    form = F.concat("nearest_station", F.lit(" ("), F.col("n").cast("string"), F.lit(")"))
    tops = ranked_text(stations, ["industry"], "nearest_station", "n", 3, form, ", ", "top_stations")
    return (
        out.join(tops, "industry", "left")
        .select(
            "industry",
            "companies_total",
            F.col("_recruiting").alias("recruiting_active"),
            "new_jobs_total",
            "median_distance_km",
            F.coalesce("top_stations", F.lit("")).alias("top_stations"),
        )
        .orderBy(F.col("companies_total").desc(), "industry")
    )


def tag_summary(jobs: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """Per tag: postings, distinct companies, median distance (the posting's, else the company's)."""
    own = F.col("distance_km") if "distance_km" in jobs.columns else F.lit(None).cast("double")
    rows = jobs.select(F.explode("tags").alias("tag"), F.col("company_business_id").alias("business_id"), own.alias("_own"))
    if companies is None:
        rows = rows.withColumn("distance_km", F.col("_own"))
    else:
        side = companies.select("business_id", F.col("distance_km").alias("_theirs"))
        rows = rows.join(side, "business_id", "left").withColumn("distance_km", F.coalesce("_own", "_theirs"))
    rows = materialize(rows.select("tag", "business_id", "distance_km"), "summary-rows")
    counts = rows.groupBy("tag").agg(F.count("*").alias("new_jobs"), F.countDistinct("business_id").alias("unique_companies"))
    middles = grouped_median(rows, ["tag"], {"median_distance_km": "distance_km"})
    return counts.join(middles, "tag", "left").orderBy(F.col("new_jobs").desc(), "tag")


def side_by_side(frames: list[DataFrame], columns: list[str]) -> DataFrame:
    """One row out of several one-row frames: stack them, then take the only non-null per column."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return stacked.agg(*[F.max(c).alias(c) for c in columns])


def kpi(new_jobs: DataFrame, shortlist: DataFrame | None = None, stats: DataFrame | None = None) -> DataFrame:
    """Key figures of a run in one row; parts without an input are null."""
    frames = [new_jobs.agg(F.count("*").alias("new_jobs_total"))]
    if shortlist is not None:
        frames.append(shortlist.agg(F.count_if("recruiting_active").alias("companies_recruiting_active")))
    if stats is not None:
        frames.append(stats.agg(F.count("*").alias("domains_crawled"), F.count_if(F.col("jobs_found") > 0).alias("domains_with_jobs")))
        skips = stats.where("status <> 'ok'").groupBy("status").agg(F.count("*").alias("n"))
        form = F.concat_ws(":", "status", F.col("n").cast("string"))
        frames.append(ranked_text(skips, [], "status", "n", 3, form, ";", "top_skip_reasons"))
    empty = {
        "new_jobs_total": "bigint", "companies_recruiting_active": "bigint", "domains_crawled": "bigint",
        "domains_with_jobs": "bigint", "top_skip_reasons": "string",
    }
    have = {c for f in frames for c in f.columns}
    frames[0] = frames[0].withColumns({c: F.lit(None).cast(t) for c, t in empty.items() if c not in have})
    return side_by_side(frames, list(empty))


def top_companies(shortlist: DataFrame, new_jobs: DataFrame, all_jobs: DataFrame | None = None, top_n: int = 50) -> DataFrame:
    """Companies by new postings, then score, with their three most frequent tags.

    The limit is taken before the tags are looked up: only the listed companies need theirs.
    """
    counts = jobs_per_company(new_jobs)
    listed = (
        shortlist.select("business_id", "name", "score", "distance_km", F.col("nearest_station").alias("station"), "recruiting_active")
        .join(counts, "business_id", "left")
        .withColumn("new_jobs_count", F.coalesce("n_jobs", F.lit(0)))
        .drop("n_jobs")
        .orderBy(F.col("new_jobs_count").desc(), F.col("score").desc_nulls_last(), "business_id")
        .limit(top_n)
    )
    source = new_jobs if all_jobs is None else all_jobs
    tags = (
        source.select(F.col("company_business_id").alias("business_id"), "tags")
        .join(listed.select("business_id"), "business_id", "left_semi")
        .select("business_id", F.explode("tags").alias("tag"))
        .groupBy("business_id", "tag")
        .agg(F.count("*").alias("n"))
    )
    form = F.concat("tag", F.lit("("), F.col("n").cast("string"), F.lit(")"))
    tops = ranked_text(tags, ["business_id"], "tag", "n", 3, form, ";", "top_tags")
    out = listed.join(tops, "business_id", "left").withColumn("top_tags", F.coalesce("top_tags", F.lit("")))
    return out.orderBy(F.col("new_jobs_count").desc(), F.col("score").desc_nulls_last(), "business_id")


def quality_alerts(view: DataFrame) -> DataFrame:
    return view.agg(
        F.count_if(F.col("website_url").isNull()).alias("missing_website"),
        F.count_if(F.col("lat").isNull() | F.col("lon").isNull()).alias("missing_latlon"),
        F.count_if(F.col("industry_effective").isNull()).alias("missing_industry"),
    )


def jobs_by_company(jobs: DataFrame, companies: DataFrame) -> DataFrame:
    """Companies of the postings: count, score, and the first name a posting has, else the company's.

    The postings are counted before the join, so a company with very many of them is one row there.
    """
    own = F.min_by("company_name", F.when(usable("company_name").isNotNull(), F.col("ord")))
    counted = (
        jobs.where("company_business_id IS NOT NULL")
        .groupBy(F.col("company_business_id").alias("business_id"))
        .agg(own.alias("_own"), F.count("*").alias("job_count"))
    )
    joined = counted.join(companies.select("business_id", "name", "score"), "business_id", "left")
    return joined.select(
        "business_id", F.coalesce("_own", usable("name"), F.lit("")).alias("name"), "job_count", "score"
    ).orderBy(F.col("job_count").desc(), F.col("score").desc_nulls_last(), "name", "business_id")


def top_counts(jobs: DataFrame, by: Column, name: str, limit: int = 50) -> DataFrame:
    """Postings per value of an expression, the most frequent first."""
    rows = jobs.select(by.alias(name)).where(F.col(name).isNotNull())
    return rows.groupBy(name).agg(F.count("*").alias("new_jobs")).orderBy(F.col("new_jobs").desc(), name).limit(limit)


def jobs_by_tag(jobs: DataFrame, limit: int = 50) -> DataFrame:
    return top_counts(jobs, F.explode("tags"), "tag", limit)


def map_bounds(companies: DataFrame) -> DataFrame:
    """Centre (median and mean) and box of the located companies, with a fallback centre."""
    rows = materialize(companies.where("lat IS NOT NULL AND lon IS NOT NULL").select(F.lit(1).alias("_all"), "lat", "lon"), "located-rows")
    middle = grouped_median(rows, ["_all"], {"median_lat": "lat", "median_lon": "lon"}).drop("_all")
    box = rows.agg(
        *[f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))],
        F.count("*").alias("n_points"),
    )
    names = middle.columns + box.columns
    typed = box.withColumns({c: F.lit(None).cast("double") for c in middle.columns})
    out = side_by_side([typed, middle], names)
    lat, lon = MAP_FALLBACK_CENTER
    fallback = {c: F.coalesce(c, F.lit(lat if c.endswith("lat") else lon)) for c in ("median_lat", "median_lon", "mean_lat", "mean_lon")}
    return out.withColumns(fallback)


def classifier_metrics(df: DataFrame, predicted: str = "predicted", truth: str = "label", positive: str = "yes", unsure: str = "unclear") -> DataFrame:
    """Accuracy, precision and recall for the positive class, and the share of unsure answers."""
    hit, said = F.col(truth) == positive, F.col(predicted) == positive
    counted = df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col(predicted) == F.col(truth)).alias("right"),
        F.count_if(said & hit).alias("tp"),
        F.count_if(said & ~hit).alias("fp"),
        F.count_if(~said & hit).alias("fn"),
        F.count_if(F.col(predicted) == unsure).alias("unsure"),
    )

    def share(part: Column, whole: Column) -> Column:
        return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))

    total = F.col("total")
    return counted.select(
        "total",
        share(F.col("right"), total).alias("accuracy"),
        share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        share(F.col("unsure"), total).alias("uncertain_rate"),
    )


def within_thresholds(
    metrics: DataFrame, *, min_precision: float | None = None, min_recall: float | None = None, max_uncertain: float | None = None
) -> DataFrame:
    """Metrics with ``passed``: every threshold that is given holds."""
    ok = F.lit(True)
    if min_precision is not None:
        ok &= F.col("precision") >= min_precision
    if min_recall is not None:
        ok &= F.col("recall") >= min_recall
    if max_uncertain is not None:
        ok &= F.col("uncertain_rate") <= max_uncertain
    return metrics.withColumn("passed", ok)


def nearby_report(companies: DataFrame, radius_km: float) -> DataFrame:
    return companies.where(F.col("distance_km") <= radius_km).orderBy("distance_km", "business_id")
