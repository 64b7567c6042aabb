"""Features of landed pages: text, links, consent and cookie walls, ATS boards, URL classes."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from hireatlas import rules
from hireatlas.functions import html as H
from hireatlas.functions.keywords import any_of, keyword_places, listed
from hireatlas.functions.markup import page_parts
from hireatlas.functions.text import contains_any
from hireatlas.functions.urls import is_listing_url, is_non_job_url, resolve_url, url_key
from hireatlas.operators.once import compute_once, with_fields


@dataclass(frozen=True)
class Vocabulary:
    """Word lists of the page tests; the defaults are the Finnish and English ones."""

    evidence: list[str] = field(default_factory=lambda: rules.EVIDENCE_KEYWORDS)
    negative: list[str] = field(default_factory=lambda: rules.NEGATIVE_KEYWORDS)
    job_phrases: list[str] = field(default_factory=lambda: rules.JOB_SIGNAL_PHRASES)
    structured_marker: str = rules.STRUCTURED_MARKER
    cookie_words: list[str] = field(default_factory=lambda: rules.COOKIE_WALL_KEYWORDS)
    cookie_signals: dict[str, list[str]] = field(default_factory=lambda: rules.COOKIE_WALL_SIGNALS)
    cookie_limits: dict[str, float] = field(default_factory=lambda: rules.COOKIE_WALL_LIMITS)
    consent_words: list[str] = field(default_factory=lambda: rules.CONSENT_KEYWORDS)
    consent_pair: list[str] = field(default_factory=lambda: rules.CONSENT_PAIR)
    tag_rules: dict[str, list[str]] = field(default_factory=lambda: rules.TAG_RULES)
    url_hints: list[str] = field(default_factory=lambda: rules.JOB_URL_HINTS)
    text_hints: list[str] = field(default_factory=lambda: rules.JOB_TEXT_HINTS)
    listing_paths: list[str] = field(default_factory=lambda: rules.LISTING_PATHS)
    non_job_paths: list[str] = field(default_factory=lambda: rules.NON_JOB_PATH_HINTS)
    non_job_queries: list[str] = field(default_factory=lambda: rules.NON_JOB_QUERY_HINTS)


DEFAULT_VOCABULARY = Vocabulary()


def page_text(pages: DataFrame, max_chars: int | None = None) -> DataFrame:
    """Add ``title`` and the visible ``text``, whole unless a model prompt asks for a limit."""
    rows = with_fields(pages, page_parts(F.col("html"), "title", "text"))
    return rows if max_chars is None else rows.withColumn("text", F.left("text", F.lit(max_chars)))


def page_links(pages: DataFrame, url_hints: list[str], text_hints: list[str]) -> DataFrame:
    """Links whose address or text matches a hint: absolute, distinct, in page order.

    The links of a page stay in its row until they are matched and distinct, so nothing is shuffled.
    """

    def wanted(link: Column) -> Column:
        return contains_any(F.lower(link["href"]), url_hints) | contains_any(link["text"], text_hints)

    found = F.filter(H.links(F.col("html")), wanted)
    targets = F.array_distinct(F.transform(found, lambda link: resolve_url(F.col("url"), link["href"])))
    # The outer form reads the list once; the plain one would also test its size in a filter below.
    return pages.select("page_id", F.posexplode_outer(targets).alias("ord", "target")).where("target IS NOT NULL")


def url_classes(pages: DataFrame, vocabulary: Vocabulary = DEFAULT_VOCABULARY, url: str = "url") -> DataFrame:
    v = vocabulary
    return pages.withColumns(
        {
            "is_listing": is_listing_url(F.col(url), v.listing_paths),
            "is_non_job": is_non_job_url(F.col(url), v.non_job_paths, v.non_job_queries),
        }
    )


def is_consent_text(places: Column, vocabulary: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """Two words of the consent list, or both words of the deciding pair, among the words of a page (`keyword_places`)."""
    pair = reduce(lambda a, b: a & b, [any_of(places, [w]) for w in vocabulary.consent_pair])
    return (F.size(listed(places, vocabulary.consent_words)) >= 2) | pair


def consent_pages(pages: DataFrame, vocabulary: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    page = compute_once(pages, {"_page": page_parts(F.col("html"), "title", "body")})
    words = [*vocabulary.consent_words, *vocabulary.consent_pair]
    rows = compute_once(page, {"_words": keyword_places(F.lower(F.concat_ws(" ", "_page.title", "_page.body")), words)})
    return rows.withColumn("is_consent", is_consent_text(F.col("_words"), vocabulary)).drop("_page", "_words")


def cookie_wall(texts: DataFrame, vocabulary: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Add the cookie-wall columns to rows with ``title`` and ``text``."""
    v, limits = vocabulary, vocabulary.cookie_limits
    words = [*v.cookie_words, *(w for group in v.cookie_signals.values() for w in group)]
    rows = compute_once(texts, {"_words": keyword_places(F.lower(F.concat_ws(" ", "title", "text")), words)})
    rows = compute_once(rows, {"wall_matches": listed(F.col("_words"), v.cookie_words)})
    hits = F.size("wall_matches")
    score = F.least(F.lit(1.0), hits / F.lit(5.0))
    soft = (hits >= limits["hits_min"]) & (score >= limits["score_min"]) & (F.length("text") < limits["text_max_len"])
    signals = F.array_compact(F.array(*[F.when(any_of(F.col("_words"), group), F.lit(name)) for name, group in v.cookie_signals.items()]))
    return rows.withColumns(
        {
            "wall_hits": hits,
            "wall_score": score,
            "is_wall": soft | (hits >= limits["hits_hard"]),
            "wall_signals": signals,
        }
    ).drop("_words")


def _host_hit(text: Column, name: str) -> Column:
    """The host name as such, not as the tail of a longer label or the start of a longer name."""
    escaped = name.replace(".", r"\.")
    return text.rlike(rf"(?:^|[^A-Za-z0-9\-]){escaped}(?:[^A-Za-z0-9\-]|$)")


def detect_ats(url: Column, html: Column, bare_substring: bool = False) -> Column:
    """``struct<kind, slug>`` of the applicant-tracking board a page is or links to, else null.

    ``bare_substring`` also accepts the board's name inside a longer host name.
    """
    none = F.lit(None).cast("string")

    def part(pattern: str) -> Column:
        return F.when(url.rlike(pattern), F.regexp_extract(url, pattern, 1))

    def board(kind: str, slug: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), slug.alias("slug"))

    if bare_substring:
        lever = F.contains(url, F.lit("lever.co")) | F.contains(html, F.lit("lever.co"))
    else:
        lever = _host_hit(url, "lever.co") | _host_hit(html, "lever.co")
    hire = F.when(F.contains(html, F.lit("hire.lever.co")), F.lit("hire")).otherwise(none)
    return (
        F.when(lever, board("lever", F.coalesce(part(r"lever\.co/([^/]*)"), hire)))
        .when(
            F.contains(url, F.lit("greenhouse.io")) | F.contains(html, F.lit("boards.greenhouse.io")),
            board("greenhouse", part(r"greenhouse[^/]*/([^/]*)")),
        )
        .when(
            F.contains(url, F.lit("recruitee.com")) | F.contains(html, F.lit("recruitee.com")),
            board("recruitee", part(r"(?:^|/)([^/.]*)[^/]*\.recruitee\.com(?:/|$)")),
        )
        .when(
            F.contains(url, F.lit("teamtailor")) | F.contains(html, F.lit("teamtailor")),
            board("teamtailor", part(r"(?:^|/)([^/.]*)[^/]*\.teamtailor\.com(?:/|$)")),
        )
    )


def ats_link_kind(link: Column) -> Column:
    """Board kind of a link by the link patterns, else null."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(rules.ATS_LINK_PATTERNS.items()):
        out = F.when(link.rlike(pattern), F.lit(kind)).otherwise(out)
    return out


def has_job_signal(html: Column, places: Column, vocabulary: Vocabulary = DEFAULT_VOCABULARY) -> Column:
    """Structured data, or a job phrase among the words of the body text (`keyword_places`)."""
    return F.contains(F.lower(html), F.lit(vocabulary.structured_marker)) | any_of(places, vocabulary.job_phrases)


def job_signal(pages: DataFrame, vocabulary: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    rows = compute_once(pages, {"_words": keyword_places(F.lower(H.body_text(F.col("html"))), vocabulary.job_phrases)})
    return rows.withColumn("has_signal", has_job_signal(F.col("html"), F.col("_words"), vocabulary)).drop("_words")


def sitemap_urls(sitemaps: DataFrame, keywords: list[str] = rules.SITEMAP_KEYWORDS, limit: int | None = None) -> DataFrame:
    """Locations of a sitemap that hold a keyword; ``limit`` is the crawl budget per sitemap."""
    found = F.filter(H.sitemap_locations(F.col("xml")), lambda u: contains_any(F.lower(u), keywords))
    return sitemaps.select("domain", F.posexplode_outer(found if limit is None else F.slice(found, 1, limit)).alias("ord", "url")).where("url IS NOT NULL")


def career_suggestions(
    companies: DataFrame, home_links: DataFrame, signal_pages: DataFrame, paths: list[str] = rules.SCAN_PATHS
) -> DataFrame:
    """Best careers address per company: a board link, else a usual path, else a home page link.

    ``companies`` has ``business_id, name, domain``; ``home_links`` has ``business_id, ord, link``;
    ``signal_pages`` has ``url_key`` of landed pages with a job signal.
    """
    signals = signal_pages.select("url_key").distinct()
    kind = ats_link_kind(F.col("link"))
    board = home_links.withColumn("_kind", kind).where(F.col("_kind").isNotNull()).select(
        "business_id",
        F.lit(0).alias("rank"),
        "ord",
        F.col("link").alias("suggested_base_url"),
        F.lit("ats").alias("source"),
        F.lit("high").alias("confidence"),
        F.concat(F.lit("found "), "_kind", F.lit(" link")).alias("reason"),
    )
    usual = companies.select(
        "business_id", F.posexplode(F.array(*[F.struct(F.concat(F.lit("https://"), "domain", F.lit(p)).alias("u"), F.lit(p).alias("p")) for p in paths])).alias("ord", "c")
    ).select(
        "business_id",
        F.lit(1).alias("rank"),
        "ord",
        F.col("c.u").alias("suggested_base_url"),
        F.lit("common_path").alias("source"),
        F.lit("med").alias("confidence"),
        F.concat(F.lit("matched common path "), F.col("c.p")).alias("reason"),
    )
    linked = home_links.select(
        "business_id",
        F.lit(2).alias("rank"),
        "ord",
        F.col("link").alias("suggested_base_url"),
        F.lit("homepage_link").alias("source"),
        F.lit("med").alias("confidence"),
        F.lit("homepage link with job signals").alias("reason"),
    )
    backed = usual.unionByName(linked).withColumn("url_key", url_key(F.col("suggested_base_url"))).join(signals, "url_key", "left_semi").drop("url_key")
    columns = ["suggested_base_url", "source", "confidence", "reason"]
    best = board.unionByName(backed).groupBy("business_id").agg(F.min_by(F.struct(*columns), F.struct("rank", "ord")).alias("_s"))
    return companies.select("business_id", "name", F.col("domain").alias("homepage_domain")).join(
        best.select("business_id", "_s.*"), "business_id"
    )


