"""The hiring-signal run and the company documents built from it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from hireatlas import rules
from hireatlas.functions.keywords import keyword_places, snippets_at
from hireatlas.functions.markup import page_parts
from hireatlas.functions.text import filled, literal_array, strip
from hireatlas.functions.urls import clean_domain, maps_host_allowed, place_id
from hireatlas.operators.companies import last_row
from hireatlas.operators.crawl import access_gate, site_candidates
from hireatlas.operators.once import compute_once, with_fields
from hireatlas.operators.pages import DEFAULT_VOCABULARY, Vocabulary, cookie_wall
from hireatlas.operators.signal import (
    evidence_downgrade, evidence_gate, evidence_pairs, page_verdict, prompt_version, signal_rank,
)
from hireatlas.session import materialize

PACKAGE_SCHEMA_VERSION = "0.1"  # fixed value


@dataclass(frozen=True)
class Run:
    """Provenance of a run, as it appears in every output row."""

    run_id: str
    crawl_ts: str
    station: str
    max_distance_km: float
    tool_version: str = "1.0"
    git_sha: str = ""
    model: str = ""
    temperature: float = 0.2
    deterministic: bool = False
    model_used: bool = False
    output_format: str = "csv"


def landed_pages(candidates: DataFrame, pages: DataFrame) -> DataFrame:
    """The one landed page per wanted address: only those have their text worked on."""
    keys = candidates.where("page_id IS NOT NULL").select("page_id").distinct()
    return pages.join(keys, "page_id", "left_semi")


def scan(
    companies: DataFrame,
    pages: DataFrame,
    access_rules: DataFrame,
    *,
    answers: DataFrame | None = None,
    vocabulary: Vocabulary = DEFAULT_VOCABULARY,
    paths: list[str] = rules.SCAN_PATHS,
    max_urls: int | None = None,
    allow_domains: list[str] | None = None,
) -> DataFrame:
    """Candidates with their gate, wall and verdict columns: one row per company and candidate.

    ``max_urls`` is the scan budget per company; without it all its candidates are looked at.
    ``answers`` (``page_id`` and verdict columns) are model verdicts for pages the heuristics leave open; of several for a
    page the last one by ``ord`` counts. An answer without addresses speaks of its own page, and one without the field of
    excerpts (null) takes those of the page, before the evidence gate. ``allow_domains`` are company domains whose access rules
    are overridden.
    """
    # Addresses are matched over a narrow stored table; the HTML is read once, for the pages that are asked for.
    keys = materialize(pages.select("page_id", "url"), "page-keys")
    wanted = materialize(site_candidates(companies, keys, paths=paths, limit=max_urls), "scan-wanted")
    gated = materialize(access_gate(wanted, access_rules, allow_domains, "domain"), "scan-candidates")
    asked = landed_pages(gated.where("allowed"), pages).select("page_id", "url", "html")
    texts = with_fields(asked, page_parts(F.col("html"), "title", "text", "body"))
    judged = page_verdict(cookie_wall(texts, vocabulary), vocabulary)
    verdict = ["signal", "confidence", "evidence", "evidence_snippets", "evidence_urls"]
    walls = ["is_wall", "wall_hits", "wall_score", "wall_matches", "wall_signals"]
    columns = ["page_id", F.col("url").alias("final_url"), "title", *walls]
    if answers is None:
        facts = judged.select(*columns, *verdict)
    else:
        facts = _with_answers(judged, answers, vocabulary).select(*columns, *verdict, "_answered")
    # A page the heuristics leave open counts as unclear without evidence, unless a model answered.
    open_page = F.col("signal") != "yes"
    if answers is None:
        plain = {"confidence": F.lit(0.0), "evidence": F.lit(""), "evidence_snippets": literal_array([]), "evidence_urls": F.array("final_url")}
        facts = facts.withColumns({c: F.when(open_page, v).otherwise(F.col(c)) for c, v in plain.items()})
    return gated.join(facts.drop("_answered"), "page_id", "left")


def _with_answers(judged: DataFrame, answers: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Judged pages; those left open carry their gated answer, if there is one (``_answered``)."""
    verdict = ["signal", "confidence", "evidence", "evidence_snippets", "evidence_urls"]
    one = last_row(answers, "page_id", verdict)
    rows = judged.select("*", F.struct(*verdict).alias("_own")).join(one, "page_id", "left")
    rows = compute_once(rows, {"_words": keyword_places(F.lower("text"), vocabulary.evidence)})
    urls = F.coalesce("_last.evidence_urls", literal_array([]))
    taken = {
        **{c: F.col(f"_last.{c}") for c in ("signal", "confidence", "evidence")},
        "evidence_snippets": F.coalesce("_last.evidence_snippets", snippets_at(F.col("text"), F.col("_words"), vocabulary.evidence, 3)),
        "evidence_urls": F.when(F.size(urls) == 0, F.array("url")).otherwise(urls),
    }
    answered = (F.col("_own.signal") != "yes") & F.col("_last").isNotNull()
    gated = evidence_gate(rows.withColumn("_answered", answered).withColumns(taken), vocabulary)
    return gated.withColumns({c: F.when(F.col("_answered"), F.col(c)).otherwise(F.col(f"_own.{c}")) for c in verdict}).drop("_own", "_last", "_words")


def scan_summary(scanned: DataFrame) -> DataFrame:
    """Per company: the selected verdict, the addresses looked at, the errors and the strongest wall.

    The lists are as long as the candidate list of a company: its website and the fixed paths.
    """
    fetched = F.col("allowed") & F.col("final_url").isNotNull()
    skipped = F.when(~F.col("allowed"), F.col("skip_reason")).when(~fetched, F.lit("fetch_failed"))
    address = F.when(fetched, F.col("final_url")).otherwise(F.col("url"))
    wall_note = F.concat(
        address, F.lit(":cookie_wall:"), F.col("wall_hits").cast("string"), F.lit(":"), F.format_number("wall_score", 2), F.lit(":"),
        F.array_join(F.slice("wall_matches", 1, 5), ","),
    )
    error = F.when(skipped.isNotNull(), F.concat(address, F.lit(":"), skipped)).when(F.col("is_wall"), wall_note)
    rows = scanned.withColumns({"_skipped": skipped, "_address": address, "_error": error})
    counted = fetched & ~F.coalesce("is_wall", F.lit(False))

    def in_order(value: str) -> Column:
        listed = F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct("ord", F.col(value).alias("v")))))
        return F.transform(listed, lambda e: e["v"])

    # Everything about a company comes out of one aggregation, so its pages are judged once.
    verdict = ["signal", "confidence", "evidence", "evidence_snippets", "evidence_urls"]
    strength = F.struct(signal_rank(F.col("signal")), "confidence", -F.col("ord"))
    wall = F.struct(
        F.lit(True).alias("detected"),
        F.col("wall_score").alias("score"),
        F.col("wall_hits").alias("hit_count"),
        F.col("wall_signals").alias("signals"),
        F.left("title", F.lit(120)).alias("sample_title"),
        F.slice("wall_matches", 1, 5).alias("matches"),
    )
    grouped = rows.groupBy("business_id").agg(
        in_order("_address").alias("checked_urls"),
        in_order("_error").alias("errors"),
        F.array_sort(F.collect_set("_skipped")).alias("skipped_reasons"),
        F.count_if(fetched).alias("pages_fetched"),
        (F.count_if(counted) > 0).alias("results_found"),
        F.max_by(F.struct(*verdict, F.col("final_url").alias("signal_url")), F.when(counted, strength)).alias("_best"),
        F.max_by(wall, F.when(fetched & F.col("is_wall"), F.struct("wall_score", -F.col("ord")))).alias("cookie_wall"),
    )
    best = F.col("_best")
    return grouped.withColumns(
        {
            "signal": F.coalesce(best["signal"], F.lit("unclear")),
            "confidence": F.coalesce(best["confidence"], F.lit(0.0)),
            "evidence": F.coalesce(best["evidence"], F.lit("")),
            "evidence_snippets": F.coalesce(best["evidence_snippets"], literal_array([])),
            "evidence_urls": F.coalesce(best["evidence_urls"], literal_array([])),
            "signal_url": F.coalesce(best["signal_url"], F.lit("")),
        }
    ).drop("_best")


def hiring_signal(targets: DataFrame, summary: DataFrame, run: Run) -> DataFrame:
    """Contract rows of a run: the targets with their scan summary and the run's provenance."""
    reasons = F.when(~F.col("results_found"), F.array_join("skipped_reasons", ";")).otherwise(F.lit(""))
    return targets.select("business_id", "name", "domain").join(summary, "business_id").select(
        F.lit(run.run_id).alias("run_id"),
        F.lit(run.tool_version).alias("tool_version"),
        F.lit(run.git_sha).alias("git_sha"),
        F.lit(run.crawl_ts).alias("crawl_ts"),
        F.lit(run.station).alias("station"),
        F.lit(run.max_distance_km).alias("max_distance_km"),
        "business_id",
        F.coalesce("name", F.lit("")).alias("name"),
        "domain",
        "signal",
        "confidence",
        "evidence",
        "evidence_snippets",
        "evidence_urls",
        "signal_url",
        F.array_join("checked_urls", ";").alias("checked_urls"),
        F.lit("").alias("next_url_hint"),
        F.array_join("errors", ";").alias("errors"),
        reasons.alias("skipped_reason"),
        F.lit(run.model).alias("ollama_model"),
        F.lit(run.temperature).alias("ollama_temperature"),
        prompt_version().alias("prompt_version"),
        F.lit(run.deterministic).alias("deterministic"),
        F.lit(run.model_used).alias("llm_used"),
        F.lit(run.output_format).alias("output_format"),
    )


# Outcome ladder of a request, with the texts of each outcome.
NEXT_WEBSITE = "Paste official website URL to proceed."
NEXT_WALL = "Cookie wall detected. Open site manually and retry."
OUTCOMES = {
    # code: (status, degraded reason, resolver notes, website source, next action, message)
    "invalid_maps_url": ("error", "none", "Invalid Maps URL host.", "unknown", "", "Maps URL host is not supported."),
    "place_id_not_found": (
        "degraded", "place_id_not_found", "Could not resolve place_id from Maps URL.", "unknown", NEXT_WEBSITE,
        "Could not resolve place_id from Maps URL.",
    ),
    "places_lookup_failed": ("error", "none", "Places lookup failed.", "places", "", "Places lookup failed."),
    "website_missing": (
        "degraded", "website_missing", "Places had no websiteUri.", "places", NEXT_WEBSITE, "Place has no websiteUri.",
    ),
    "cookie_wall": ("degraded", "cookie_wall", "Resolved via Places websiteUri.", "places", NEXT_WALL, None),
    "ok": ("ok", "none", "Resolved via Places websiteUri.", "places", "", None),
}


def resolve_requests(requests: DataFrame, websites: DataFrame) -> DataFrame:
    """Add place id, website and domain to map-link requests.

    ``requests`` has ``run_id, maps_url, note, tags``; ``websites`` has ``place_id, website_url,
    lookup_error``, the landed answers of the place lookup; of several, the last one by ``ord`` counts.
    """
    looked_up = last_row(websites, "place_id", ["website_url", "lookup_error"]).select("place_id", "_last.*")
    rows = requests.withColumns({"host_allowed": maps_host_allowed(F.col("maps_url")), "place_id": place_id("maps_url")})
    return rows.join(looked_up, "place_id", "left").withColumns(
        {"website_url": F.coalesce(strip("website_url"), F.lit("")), "domain": clean_domain("website_url")}
    )


def company_packages(resolved: DataFrame, summary: DataFrame, run: Run) -> DataFrame:
    """One nested document per request, complete or degraded.

    ``summary`` is the scan summary with the request's ``run_id`` as ``business_id``.
    """
    scanned = summary.withColumnRenamed("business_id", "run_id")
    rows = resolved.join(scanned, "run_id", "left")
    outcome = (
        F.when(~F.coalesce("host_allowed", F.lit(False)), F.lit("invalid_maps_url"))
        .when(filled("place_id").isNull(), F.lit("place_id_not_found"))
        .when(F.col("lookup_error").isNotNull(), F.lit("places_lookup_failed"))
        .when(F.col("website_url") == "", F.lit("website_missing"))
        .when(F.col("cookie_wall").isNotNull() & ~F.coalesce("results_found", F.lit(False)), F.lit("cookie_wall"))
        .otherwise(F.lit("ok"))
    )
    rows = evidence_downgrade(rows.withColumn("_outcome", outcome))
    live = F.col("_outcome").isin("ok", "cookie_wall")
    none = literal_array([])

    def text_of(position: int) -> Column:
        out = F.lit(None).cast("string")
        for code, texts in OUTCOMES.items():
            out = F.when(F.col("_outcome") == code, F.lit(texts[position]).cast("string")).otherwise(out)
        return out

    def when_live(column: Column, otherwise: Column) -> Column:
        return F.coalesce(F.when(live, column), otherwise)

    lookup_note = F.concat(F.lit("places_lookup_failed:"), "lookup_error")
    failure = F.array(F.when(F.col("_outcome") == "places_lookup_failed", lookup_note).otherwise(F.col("_outcome")))
    page_errors = F.filter(F.coalesce("errors", none), lambda e: ~F.contains(e, F.lit(":cookie_wall:")))
    signals = F.concat(
        F.when(F.coalesce("evidence", F.lit("")) != "", F.array("evidence")).otherwise(none), F.coalesce("hiring_reasons", none)
    )
    limits = rules.COOKIE_WALL_LIMITS
    threshold = F.struct(*[F.lit(limits[k]).alias(k) for k in ("hits_min", "score_min", "text_max_len", "hits_hard")])
    wall = F.col("cookie_wall")
    empty_evidence = F.array().cast("array<struct<snippet:string,url:string>>")
    source = F.struct(
        F.col("maps_url").alias("source_ref"),
        F.when(F.col("_outcome") == "invalid_maps_url", F.lit("")).otherwise(F.coalesce("place_id", F.lit(""))).alias("place_id"),
        when_live(F.col("domain"), F.lit("")).alias("canonical_domain"),
        text_of(3).alias("website_source"),
        text_of(2).alias("resolver_notes"),
    )
    hiring = F.struct(
        when_live(F.col("hiring_status"), F.lit("uncertain")).alias("status"),
        when_live(F.col("hiring_confidence"), F.lit(0.0)).alias("confidence"),
        when_live(signals, none).alias("signals"),
        when_live(evidence_pairs(F.coalesce("evidence_snippets", none), F.coalesce("evidence_urls", none)), empty_evidence).alias("evidence"),
    )
    links = F.struct(
        "maps_url",
        when_live(F.col("website_url"), F.lit("")).alias("website_url"),
        none.alias("careers_urls"),
        none.alias("ats_urls"),
        F.lit("").alias("contact_url"),
    )
    cookie = F.struct(
        F.coalesce(wall["detected"], F.lit(False)).alias("detected"),
        F.coalesce(wall["score"], F.lit(0.0)).alias("score"),
        F.coalesce(wall["hit_count"], F.lit(0)).alias("hit_count"),
        F.coalesce(wall["signals"], none).alias("signals"),
        threshold.alias("threshold"),
        F.coalesce(wall["sample_title"], F.lit("")).alias("sample_title"),
        F.coalesce(wall["matches"], none).alias("matches"),
    )
    safety = F.struct(
        F.lit("unknown").alias("robots_respected"),
        when_live(F.col("pages_fetched"), F.lit(0)).alias("pages_fetched"),
        when_live(F.col("skipped_reasons"), none).alias("skipped_reasons"),
        F.when(live, page_errors).otherwise(failure).alias("errors"),
        when_live(F.col("checked_urls"), none).alias("checked_urls"),
        cookie.alias("cookie_wall"),
        (live & F.lit(run.model_used)).alias("llm_used"),
        F.when(live, prompt_version()).otherwise(F.lit("")).alias("prompt_version"),
        F.when(live, F.lit(run.model)).otherwise(F.lit("")).alias("ollama_model"),
        F.when(live, F.lit(run.temperature)).otherwise(F.lit(0.0)).alias("ollama_temperature"),
        (live & F.lit(run.deterministic)).alias("deterministic"),
    )
    industry = F.struct(none.alias("labels"), F.lit(0.0).alias("confidence"), empty_evidence.alias("evidence"))
    fit = F.struct(F.lit(0).alias("score"), none.alias("green_flags"), none.alias("red_flags"), empty_evidence.alias("evidence"))
    error = F.when(~live & text_of(5).isNotNull(), F.struct(F.col("_outcome").alias("code"), text_of(5).alias("message")))
    return rows.select(
        "run_id",
        F.struct(
            text_of(0).alias("status"),
            text_of(1).alias("degraded_reason"),
            F.lit(PACKAGE_SCHEMA_VERSION).alias("schema_version"),
            "run_id",
            F.lit(run.crawl_ts).alias("created_at"),
            F.lit(run.tool_version).alias("tool_version"),
            F.lit(run.git_sha).alias("git_sha"),
            source.alias("source"),
            hiring.alias("hiring"),
            industry.alias("industry"),
            F.struct(none.alias("detected"), fit.alias("fit")).alias("roles"),
            links.alias("links"),
            text_of(4).alias("next_action"),
            safety.alias("safety"),
            F.struct(F.coalesce("note", F.lit("")).alias("note"), F.coalesce("tags", none).alias("tags")).alias("notes"),
            error.alias("error"),
        ).alias("package"),
    )


def package_json(packages: DataFrame) -> DataFrame:
    return packages.select("run_id", F.to_json("package").alias("package"))


def dossier_markdown(packages: DataFrame) -> DataFrame:
    """Every package as Markdown text."""
    p = F.col("package")
    some = F.lit("")
    domain, website, maps = p["source"]["canonical_domain"], p["links"]["website_url"], p["links"]["maps_url"]

    def bullets(lines: Column, fallback: str) -> Column:
        marked = F.transform(lines, lambda x: F.concat(F.lit("- "), x))
        return F.when(F.size(lines) > 0, F.array_join(marked, "\n")).otherwise(F.lit(f"- {fallback}"))

    def section(title: str, body: Column) -> Column:
        return F.concat(F.lit(f"## {title}\n"), body, F.lit("\n"))

    def evidence(title: str, entries: Column) -> Column:
        def line(e: Column) -> Column:
            both = F.concat(e["snippet"], F.lit(" ("), e["url"], F.lit(")"))
            return F.when((e["snippet"] != "") & (e["url"] != ""), both).when(e["url"] != "", e["url"]).otherwise(e["snippet"])

        return section(f"Evidence - {title}", bullets(F.transform(entries, line), "No evidence captured."))

    def prefixed(prefix: str, values: Column) -> Column:
        return F.transform(F.filter(values, lambda v: v != ""), lambda v: F.concat(F.lit(prefix), v))

    def one(condition: Column, text: Column) -> Column:
        return F.when(condition, F.array(text)).otherwise(literal_array([]))

    head = F.concat_ws(
        "\n",
        F.concat(F.lit("# "), F.when(domain != some, domain).otherwise(F.lit("Unknown company"))),
        F.when(domain != some, F.concat(F.lit("Domain: `"), domain, F.lit("`"))),
        F.when(website != some, F.concat(F.lit("Website: ["), website, F.lit("]("), website, F.lit(")"))),
        F.when(maps != some, F.concat(F.lit("Maps: [Open in Google Maps]("), maps, F.lit(")"))),
        some,
    )
    decision = F.concat_ws(
        "\n",
        F.concat(
            F.lit("**Decision:** "), F.upper(p["hiring"]["status"]), F.lit(" (confidence "),
            F.format_string("%.2f", p["hiring"]["confidence"]), F.lit(")"),
        ),
        F.when(p["status"] != "ok", F.concat(F.lit("Pipeline status: "), p["status"])),
        F.when(~p["degraded_reason"].isin("none", ""), F.concat(F.lit("Degraded reason: "), p["degraded_reason"])),
        some,
    )
    reasons = F.slice(F.filter(p["hiring"]["signals"], lambda s: strip(s) != ""), 1, 5)
    wall = p["safety"]["cookie_wall"]
    wall_detail = F.when(
        F.size(wall["signals"]) > 0, F.concat(F.lit(" (signals: "), F.array_join(wall["signals"], ", "), F.lit(")"))
    ).otherwise(some)
    caveats = F.concat(
        one(wall["detected"], F.concat(F.lit("Cookie wall detected"), wall_detail, F.lit("."))),
        prefixed("Skipped: ", p["safety"]["skipped_reasons"]),
        prefixed("Error: ", p["safety"]["errors"]),
        one(p["next_action"] != "", F.concat(F.lit("Next action: "), p["next_action"])),
    )
    note, tags = p["notes"]["note"], p["notes"]["tags"]
    note_lines = F.concat(one(note != "", note), one(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", "))))
    provenance = F.concat_ws(
        "\n",
        F.lit("## Provenance"),
        *[F.concat(F.lit(f"- {label}: "), p[name]) for label, name in [("run_id", "run_id"), ("version", "tool_version"), ("timestamp", "created_at"), ("git_sha", "git_sha")]],
        F.when(p["source"]["website_source"] != "", F.concat(F.lit("- website_source: "), p["source"]["website_source"])),
        some,
    )
    text = F.concat_ws(
        "\n",
        head,
        decision,
        section("Why", bullets(reasons, "No strong deterministic signals found.")),
        evidence("Hiring", p["hiring"]["evidence"]),
        evidence("Industry", p["industry"]["evidence"]),
        evidence("Roles", p["roles"]["fit"]["evidence"]),
        section("Unknowns & Caveats", bullets(caveats, "No major caveats recorded.")),
        F.when(F.size(note_lines) > 0, section("Notes", bullets(note_lines, ""))),
        provenance,
    )
    return packages.select("run_id", text.alias("markdown"))


