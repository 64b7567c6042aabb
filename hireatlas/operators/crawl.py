"""Landed fetch events, site access rules and page candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hireatlas import rules
from hireatlas.functions.text import filled, literal_array, strip, usable
from hireatlas.functions.urls import authority, clean_domain, path_of, query_of, url_key, with_scheme
from hireatlas.operators.companies import first_n_per_key
from hireatlas.operators.prefixes import first_rules

# The reasons that decide a domain's status.
BLOCKED_REASONS = [rules.ROBOTS_ALL, rules.ROBOTS_URL, rules.ROBOTS_UNAVAILABLE, "http_403"]
FAILED_REASONS = ["timeout", "dns", "base_fetch_failed"]
FAILED_ERRORS = ["timeout", "dns", "max_retries_exceeded"]
MAX_BYTES = 2_000_000


def skip_reason(raw: Column) -> Column:
    """Common name of a rule hit."""
    return (
        F.when(raw == "Disallow: /", F.lit(rules.ROBOTS_ALL))
        .when(raw.isin("blocked_by_robots", "robots_disallow"), F.lit(rules.ROBOTS_URL))
        .otherwise(F.coalesce(raw, F.lit("")))
    )


def crawl_status(jobs_found: Column, skipped: Column, errors: Column) -> Column:
    """Status of a crawled domain from its postings, skip reason and distinct error kinds."""

    def has(kinds) -> Column:
        return F.coalesce(F.arrays_overlap(errors, literal_array(kinds)), F.lit(False))

    return (
        F.when(jobs_found > 0, F.lit("ok"))
        .when(F.coalesce(skipped.isin(BLOCKED_REASONS), F.lit(False)) | has(["http_403"]), F.lit("blocked"))
        .when(has(["cookie_consent"]), F.lit("consent_gate"))
        .when(F.coalesce(skipped.isin(FAILED_REASONS), F.lit(False)) | has(FAILED_ERRORS), F.lit("technical_fail"))
        .otherwise(F.lit("no_signal"))
    )


ATS_COLUMNS = ("ats_detected", "ats_fetch_ok", "ats_fetch_reason")


def counter_entries(log: DataFrame) -> DataFrame:
    """What each fetch event counts for: ``domain, kind, name, n, seq, url``, a few rows per event."""
    fetched = F.col("error").isNull() & (F.col("status_code") < 400)

    def entry(kind: str, name: Column, n: Column, present: Column) -> Column:
        return F.when(present, F.struct(F.lit(kind).alias("kind"), name.alias("name"), n.cast("long").alias("n")))

    one, none = F.lit(1), F.lit("")
    entries = F.array(
        entry("event", none, one, F.lit(True)),
        entry("page", none, one, fetched),
        entry("job", none, F.col("jobs"), F.col("jobs") > 0),
        # An error names its kind before the first colon; what follows is the address.
        entry("error", F.substring_index("error", ":", 1), one, F.col("error").isNotNull()),
        entry("skip", F.col("skipped_reason"), one, F.col("skipped_reason").isNotNull()),
        entry("extractor", F.col("extractor"), one, F.col("extractor").isNotNull()),
        # Of a domain whose home page showed a job board: the board, whether its feed gave postings, and why not.
        *[entry(kind, F.col(kind).cast("string"), one, F.col(kind).isNotNull()) for kind in ATS_COLUMNS if kind in log.columns],
    )
    rows = log.select("domain", F.col("seq").cast("long").alias("seq"), "url", F.explode(F.array_compact(entries)).alias("e"))
    return rows.select("domain", "e.kind", "e.name", "e.n", "seq", "url")


def crawl_counters(log: DataFrame) -> DataFrame:
    """Counters per domain, kind and name out of fetch events.

    They add up: counters of two batches merge into those of both (:func:`merge_counters`).
    """
    return counter_entries(log).groupBy("domain", "kind", "name").agg(
        F.sum("n").alias("n"), F.min(F.struct("seq", "url")).alias("first")
    )


def merge_counters(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("domain", "kind", "name").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def stats_from_counters(counters: DataFrame) -> DataFrame:
    """Statistics per domain; the lists gathered here are the distinct names of a fixed vocabulary."""

    def total(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))

    is_error = F.col("kind") == "error"
    blocked_at = F.when(is_error & F.col("name").isin(rules.ROBOTS_ALL, rules.ROBOTS_URL), F.col("first.seq"))
    skipped_at = F.when(F.col("kind") == "skip", F.col("first.seq"))
    ranked = F.array_sort(F.collect_list(F.when(is_error, F.struct((-F.col("n")).alias("c"), "name"))))
    grouped = counters.groupBy("domain").agg(
        total("page").alias("pages_fetched"),
        total("job").alias("jobs_found"),
        F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == "extractor", F.col("name")))), ";"), F.lit("")).alias("extractor_used"),
        total("error").alias("errors_count"),
        ranked.alias("_errors"),
        F.min_by("name", skipped_at).alias("skipped_reason"),
        F.min_by("name", blocked_at).alias("robots_rule_hit"),
        F.min_by("first.url", blocked_at).alias("first_blocked_url"),
        F.min_by("name", F.when(F.col("kind") == "ats_detected", F.col("first.seq"))).alias("ats_detected"),
        (F.count_if((F.col("kind") == "ats_fetch_ok") & (F.col("name") == "true")) > 0).alias("ats_fetch_ok"),
        F.min_by("name", F.when(F.col("kind") == "ats_fetch_reason", F.col("first.seq"))).alias("ats_fetch_reason"),
    )
    histogram = F.array_join(F.transform("_errors", lambda e: F.concat_ws(":", e["name"], (-e["c"]).cast("string"))), ";")
    status = crawl_status(F.col("jobs_found"), F.col("skipped_reason"), F.transform("_errors", lambda e: e["name"]))
    return grouped.withColumns(
        {
            "errors_top": F.nullif(histogram, F.lit("")),
            "status": F.when(filled("domain").isNull(), F.lit("no_domain")).otherwise(status),
        }
    ).drop("_errors")


def crawl_stats(log: DataFrame) -> DataFrame:
    """Statistics per domain out of fetch events; a blank domain gets the status ``no_domain``.

    Errors are kept as a histogram ``kind:count`` by frequency: the events hold the full list.
    """
    return stats_from_counters(crawl_counters(log))


def fetch_outcome(log: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Add ``retryable``, ``outcome`` and ``redirected`` to fetch events."""
    code = F.col("status_code")
    outcome = (
        F.when(code.isNull(), F.coalesce("error", F.lit("max_retries_exceeded")))
        .when(code >= 400, F.concat(F.lit("http_"), code.cast("string")))
        .when(F.col("n_bytes") > max_bytes, F.lit("response_too_large"))
        .otherwise(F.lit("ok"))
    )
    moved = F.rtrim(F.coalesce("final_url", "url"), F.lit("/")) != F.rtrim("url", F.lit("/"))
    return log.withColumns(
        {
            "retryable": F.coalesce((code == 429) | code.between(500, 599), F.lit(False)),
            "outcome": outcome,
            "redirected": moved,
        }
    )


def validate_domains(domains: DataFrame, fetched: DataFrame) -> DataFrame:
    """Status per listed domain from its landed home page.

    ``fetched`` has ``domain, status_code, final_url, html, error``; of several rows of a domain the first one by ``ord``
    counts, without that column the least.
    """
    listed = domains.select(strip("business_id").alias("business_id"), strip("name").alias("name"), clean_domain("domain").alias("domain"))
    text = F.lower(F.coalesce("html", F.lit("")))
    consent = F.lit(False)
    for word in rules.CONSENT_STATUS_WORDS:
        consent = consent | F.contains(text, F.lit(word))
    # The page test runs before the join, so only a flag travels with the key.
    fact = F.struct("status_code", "final_url", F.col("error").alias("_error"), consent.alias("_consent"))
    rank = F.struct("ord", fact) if "ord" in fetched.columns else fact
    facts = fetched.select("domain", fact.alias("_fact"), rank.alias("_rank")).groupBy("domain").agg(F.min_by("_fact", "_rank").alias("_fact"))
    facts = facts.select("domain", "_fact.*")
    url = with_scheme(F.col("domain"))
    status = (
        F.when(F.col("domain") == "", F.lit("no_domain"))
        .when(F.col("status_code").isNull(), F.lit("fetch_failed"))
        .when(F.col("status_code") >= 400, F.concat(F.lit("http_"), F.col("status_code").cast("string")))
        .when(F.col("_consent"), F.lit("consent_gate"))
        .otherwise(F.lit("ok"))
    )
    moved = F.rtrim("final_url", F.lit("/")) != F.rtrim(url, F.lit("/"))
    return listed.join(facts, "domain", "left").withColumn("status", status).select(
        "business_id",
        "name",
        "domain",
        "status",
        F.coalesce(F.when(F.col("status").isin("ok", "consent_gate") & moved, F.col("final_url")), F.lit("")).alias("redirected_to"),
        F.coalesce(F.when(F.col("status") == "fetch_failed", F.col("_error")), F.lit("")).alias("reason"),
    )


def access_gate(candidates: DataFrame, access_rules: DataFrame, allow: list[str] | None = None, domain: str | None = None) -> DataFrame:
    """Add ``allowed`` and ``skip_reason`` to URL candidates.

    The first listed rule whose prefix starts the path decides (see `prefixes`); hosts without rules are open; a host
    whose rules could not be read is closed. ``allow`` lists domains for which the rules are overridden: those of the
    column ``domain``, which names the company's domain, or without it hosts of the URL.
    """
    host = F.lower(authority(F.col("url")))
    path = F.when(path_of(F.col("url")) == "", F.lit("/")).otherwise(path_of(F.col("url")))
    query = query_of(F.col("url"))
    target = F.when(query != "", F.concat(path, F.lit("?"), query)).otherwise(path)
    placed = candidates.withColumns({"_host": host, "_target": target})
    listed = access_rules.select(F.lower("host").alias("host"), F.col("path_prefix").alias("prefix"), "ord", "allow")
    asked = placed.select(F.col("_host").alias("host"), F.col("_target").alias("text")).where("host IS NOT NULL").distinct()
    first = first_rules(asked, listed.where("host IS NOT NULL AND prefix IS NOT NULL"))
    states = access_rules.groupBy(F.lower("host").alias("host")).agg(F.max("site_state").alias("site_state"))
    decided = first.join(states, "host", "left").toDF("_host", "_target", "_first", "site_state")
    joined = placed.join(decided, ["_host", "_target"], "left")
    # An empty prefix stands for a rule that blocks nothing.
    blocked = F.coalesce(~F.col("_first.allow") & ~F.col("_first.empty"), F.lit(False))
    owner = F.lower(domain) if domain else F.col("_host")
    override = F.coalesce(owner.isin([h.lower() for h in allow]), F.lit(False)) if allow else F.lit(False)
    reason = (
        F.when(override, F.lit(""))
        .when(F.col("site_state") == "unreachable", F.lit(rules.ROBOTS_UNAVAILABLE))
        .when(F.col("site_state") == "disallow_all", F.lit(rules.ROBOTS_ALL))
        .when(blocked, F.lit(rules.ROBOTS_URL))
        .otherwise(F.lit(""))
    )
    return joined.withColumn("skip_reason", skip_reason(reason)).withColumn("allowed", F.col("skip_reason") == "").drop(
        "_host", "_target", "_first", "site_state"
    )


def candidate_urls(domain: Column, website: Column, paths: list[str], limit: int | None = None) -> Column:
    """URLs to look at for a company: its website, the first path, the home page, the other paths."""
    base = F.concat(F.lit("https://"), domain)
    site = with_scheme(usable(website))
    urls = [site, F.concat(base, F.lit(paths[0])) if paths else None, base, *[F.concat(base, F.lit(p)) for p in paths[1:]]]
    listed = F.array_distinct(F.array_compact(F.array(*[u for u in urls if u is not None])))
    return F.slice(listed, 1, limit) if limit else listed


def seed_urls(domain: Column, existing: Column, paths: list[str] = rules.CRAWL_PATHS) -> Column:
    """Seeds of a crawl: the known URLs first, then the usual paths."""
    usual = F.array(*[F.concat(F.lit("https://"), domain, F.lit(p)) for p in paths])
    return F.array_distinct(F.concat(F.coalesce(existing, literal_array([])), usual))


def site_candidates(
    companies: DataFrame, pages: DataFrame, *, paths: list[str] = rules.SCAN_PATHS, limit: int | None = None, domain: str = "domain"
) -> DataFrame:
    """Candidate URLs per company, in order, with the id of the landed page for each, if any."""
    listed = companies.select(
        "business_id", F.col(domain).alias("domain"), F.posexplode(candidate_urls(F.col(domain), F.col("website_url"), paths, limit)).alias("ord", "url")
    ).withColumn("url_key", url_key(F.col("url")))
    held = pages.select(url_key(F.col("url")).alias("url_key"), "page_id").groupBy("url_key").agg(F.min("page_id").alias("page_id"))
    return listed.join(held, "url_key", "left")


def page_budget(pages: DataFrame, per_domain: int, order: str, domains: int | None = None) -> DataFrame:
    """First pages of every domain in frontier order, and optionally of the first domains only."""
    rows = pages.withColumn("domain", authority(F.col("url")))
    if domains is not None:
        firsts = rows.groupBy("domain").agg(F.min(order).alias("_first")).orderBy("_first", "domain").limit(domains)
        rows = rows.join(firsts.select("domain"), "domain", "left_semi")
    return first_n_per_key(rows, ["domain"], [F.col(order)], per_domain)
