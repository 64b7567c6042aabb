"""Watch list of new postings and the company map layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from hireatlas.functions.text import clean_tags, contains_any, filled, literal_array, usable
from hireatlas.operators.analytics import ranked_text, side_by_side
from hireatlas.rules import MARKER_RADIUS
from hireatlas.session import materialize


def _lookup(companies: DataFrame) -> DataFrame:
    """Score, distance, station and name per id; the last listed row decides."""
    picked = companies.where(filled("business_id").isNotNull()).groupBy(filled("business_id").alias("_bid"))
    row = F.struct(F.col("score"), F.col("distance_km"), F.col("nearest_station"), F.col("name"))
    return picked.agg(F.max_by(row, "ord").alias("_c"))


def watch_jobs(
    jobs: DataFrame,
    companies: DataFrame,
    *,
    include_tags: list[str] | None = None,
    exclude_keywords: list[str] | None = None,
    min_score: float | None = None,
    max_distance_km: float | None = None,
    stations: list[str] | None = None,
    restrict_to_view: bool = False,
) -> DataFrame:
    """New postings that pass the watch filter, with company attributes and the tag hit.

    Unknown company values pass. ``restrict_to_view`` drops postings of companies not in the view.
    """
    wanted = sorted({t.strip().lower() for t in include_tags or [] if t.strip()})
    banned = sorted({t.strip().lower() for t in exclude_keywords or [] if t.strip()})
    places = sorted({s.strip().lower() for s in stations or [] if s.strip()})
    how = "inner" if restrict_to_view else "left"
    rows = jobs.join(_lookup(companies), F.col("company_business_id") == F.col("_bid"), how)
    hit = F.coalesce(F.arrays_overlap(clean_tags(F.col("tags")), literal_array(wanted)), F.lit(False)) if wanted else F.lit(False)
    text = F.lower(F.concat_ws(" ", F.coalesce("job_title", F.lit("")), F.coalesce("description_snippet", F.lit(""))))
    keep = F.lit(True)
    if wanted:
        keep &= hit
    if banned:
        keep &= ~contains_any(text, banned)
    if min_score is not None:
        keep &= F.coalesce(F.col("_c.score") >= min_score, F.lit(True))
    if max_distance_km is not None:
        keep &= F.coalesce(F.col("_c.distance_km") <= max_distance_km, F.lit(True))
    if places:
        known = filled(F.col("_c.nearest_station"))
        keep &= F.coalesce(F.lower(known).isin(places), F.lit(True))
    return rows.where(keep).select(
        *[c for c in jobs.columns if c not in ("score", "distance_km", "nearest_station")],
        hit.alias("tag_hit"),
        F.col("_c.score").alias("score"),
        F.col("_c.distance_km").alias("distance_km"),
        F.col("_c.nearest_station").alias("nearest_station"),
        F.coalesce(usable("company_name"), usable(F.col("_c.name")), usable("company_domain"), F.col("company_business_id")).alias("company_label"),
        F.col("_c.name").alias("lookup_name"),
    )


def watch_order() -> list[Column]:
    """Tag hits first, then high score, then short distance; the posting order breaks ties."""
    return [
        F.col("tag_hit").desc(),
        F.coalesce("score", F.lit(-1e9)).desc(),
        F.coalesce("distance_km", F.lit(1e9)).asc(),
        F.col("ord").asc(),
    ]


def watch_list(watched: DataFrame, max_items: int | None = None) -> DataFrame:
    rows = watched.orderBy(*watch_order())
    return rows.limit(max_items) if max_items else rows


def watch_totals(jobs: DataFrame, watched: DataFrame) -> DataFrame:
    """One row: new postings before and after the watch filter."""
    return jobs.agg(F.count("*").alias("new_jobs")).select("new_jobs", watched.agg(F.count("*")).scalar().alias("listed_jobs"))


def watch_company_counts(watched: DataFrame) -> DataFrame:
    return (
        watched.groupBy("company_business_id")
        .agg(F.count("*").alias("n_jobs"), F.coalesce(F.max("lookup_name"), F.lit("")).alias("name"))
        .orderBy(F.col("n_jobs").desc(), "company_business_id")
    )


def watch_lines(watched: DataFrame, max_items: int | None = None) -> DataFrame:
    """The listed postings as report text, one block per posting, in report order."""
    extras = F.concat_ws(
        ", ",
        F.concat(F.lit("score="), F.col("score").cast("string")),
        F.concat(F.lit("distance_km="), F.col("distance_km").cast("string")),
        F.concat(F.lit("station="), filled("nearest_station")),
    )
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("- "), "company_label", F.lit(" ("), "company_business_id", F.lit("): "), F.coalesce("job_title", F.lit(""))),
        F.when(F.size("tags") > 0, F.concat(F.lit("  tags: "), F.array_join("tags", ", "))),
        F.concat(F.lit("  location: "), filled("location_text")),
        F.when(extras != "", F.concat(F.lit("  "), extras)),
        F.concat(F.lit("  link: "), F.coalesce("job_url", F.lit(""))),
    )
    return watch_list(watched, max_items).select(lines.alias("block"))


def crawl_coverage(stats: DataFrame) -> DataFrame:
    """One row: domains, domains with postings, status breakdown, top skip reasons and top errors."""
    totals = stats.agg(F.count("*").alias("domains_total"), F.count_if(F.col("jobs_found") > 0).alias("domains_with_jobs"))
    by_status = stats.where("status IS NOT NULL").groupBy("status").agg(F.count("*").alias("n"))
    count_text = F.col("n").cast("string")
    statuses = ranked_text(by_status, [], "status", "n", None, F.concat_ws("=", "status", count_text), ", ", "status_breakdown")
    skips = ranked_text(by_status.where("status <> 'ok'"), [], "status", "n", 3, F.concat_ws(": ", "status", count_text), ", ", "top_skip_reasons")
    entries = (
        stats.where("errors_top IS NOT NULL")
        .select(F.explode(F.split("errors_top", ";")).alias("entry"))
        .groupBy("entry")
        .agg(F.count("*").alias("n"))
    )
    label = F.concat(F.regexp_extract("entry", "^[^:]*", 0), F.lit(" ("), count_text, F.lit(")"))
    errors = ranked_text(entries, [], "entry", "n", 3, label, ", ", "top_errors")
    return side_by_side(
        [totals, statuses, skips, errors],
        ["domains_total", "domains_with_jobs", "status_breakdown", "top_skip_reasons", "top_errors"],
    )


def marker_color(new_jobs: Column, recruiting: Column) -> Column:
    return F.when(new_jobs > 0, "red").when(F.coalesce(recruiting, F.lit(False)), "green").otherwise("blue")


def status_color() -> Column:
    """Colour of the editing map as red, green, blue, alpha."""
    return (
        F.when(F.col("status") == "shortlist", F.lit("0,150,255,180"))
        .when((F.col("status") == "excluded") | F.coalesce("hide_flag", F.lit(False)), F.lit("160,160,160,120"))
        .when(F.coalesce("recruiting_active", F.lit(False)), F.lit("0,200,0,180"))
        .otherwise(F.lit("255,140,0,160"))
    )


def marker_radius(count: Column, max_count: Column, scale: str = "log", size: float = 1.0) -> Column:
    """Radius between the fixed bounds, by the share of the largest count."""
    low, high = MARKER_RADIUS
    share = count / max_count if scale == "linear" else F.log1p(count) / F.log1p(max_count)
    share = F.when(max_count > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(F.lit(0.0))
    radius = (F.lit(low) + F.lit(high - low) * share) * F.lit(max(0.5, min(size, 3.0)))
    return F.greatest(F.lit(low), F.least(F.lit(high), radius))


def popup_jobs(jobs: DataFrame, shown: int = 5) -> DataFrame:
    """First postings per company as popup text, and how many more there are."""
    order = Window.partitionBy("company_business_id").orderBy("ord")
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(" ["), F.array_join("tags", ", "), F.lit("]"))).otherwise(F.lit(""))
    line = F.concat(F.lit("- "), F.coalesce("job_title", F.lit("")), tags)
    firsts = (
        jobs.select("company_business_id", "ord", line.alias("line"))
        .withColumn("_rn", F.row_number().over(order))
        .where(F.col("_rn") <= shown)
        .groupBy("company_business_id")
        .agg(F.array_sort(F.collect_list(F.struct("_rn", "line"))).alias("_l"))
    )
    totals = jobs.groupBy("company_business_id").agg(F.count("*").alias("n_new"))
    more = F.when(F.col("n_new") > shown, F.concat(F.lit("... +"), (F.col("n_new") - shown).cast("string"), F.lit(" more")))
    text = F.concat_ws("\n", F.transform("_l", lambda e: e["line"]), more)
    return totals.join(firsts, "company_business_id").select("company_business_id", "n_new", text.alias("popup_jobs"))


def map_layer(companies: DataFrame, new_jobs: DataFrame, scale: str = "log", size: float = 1.0) -> DataFrame:
    """Marker attributes of the located companies: colour, radius, layers, popup and tooltip text."""
    largest = F.coalesce(companies.agg(F.max("job_count_total")).scalar(), F.lit(0))
    fresh = F.coalesce("job_count_new_since_last", F.lit(0))
    recruiting = F.coalesce("recruiting_active", F.lit(False))
    label = F.coalesce(usable("name"), usable("company_domain") if "company_domain" in companies.columns else F.lit(None), F.col("business_id"))
    note = filled("note")
    short_note = F.when(F.length(note) > 120, F.concat(F.left(note, F.lit(117)), F.lit("..."))).otherwise(note)
    layers = F.concat_ws(",", F.lit("all"), F.when(recruiting, F.lit("recruiting")), F.when(fresh > 0, F.lit("new_jobs")))
    # The postings are counted and listed, so what a diff gave is worked out once.
    fresh_jobs = materialize(new_jobs.select("company_business_id", "ord", "job_title", "tags"), "map-jobs")
    joined = companies.where("lat IS NOT NULL AND lon IS NOT NULL").join(
        popup_jobs(fresh_jobs).withColumnRenamed("company_business_id", "business_id"), "business_id", "left"
    )
    popup = F.concat_ws(
        "\n",
        F.concat(label, F.lit(" ("), "business_id", F.lit(")")),
        F.concat(F.lit("Main business line: "), filled("main_business_line")),
        F.concat(F.lit("Note: "), short_note),
        F.when(F.col("n_new") > 0, F.concat(F.lit("New jobs ("), F.col("n_new").cast("string"), F.lit("):"))).otherwise(F.lit("New jobs: 0")),
        F.col("popup_jobs"),
    )
    tooltip = F.concat(label, F.lit(" (status: "), F.coalesce("status", F.lit("")), F.lit(", new: "), fresh.cast("string"), F.lit(")"))
    return joined.select(
        "business_id",
        "lat",
        "lon",
        marker_color(fresh, recruiting).alias("color"),
        marker_radius(F.coalesce("job_count_total", F.lit(0)), largest, scale, size).alias("radius"),
        status_color().alias("status_rgba"),
        layers.alias("layers"),
        popup.alias("popup"),
        tooltip.alias("tooltip"),
    )
