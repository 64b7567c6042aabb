"""Job postings out of structured data, detail pages and board feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hireatlas.functions import html as H
from hireatlas.functions.keywords import keyword_places, rule_words, tags_at
from hireatlas.functions.markup import page_parts
from hireatlas.functions.text import detect_tags, filled
from hireatlas.functions.urls import is_listing_url, is_non_job_url, resolve_url, url_key
from hireatlas.functions.values import json_text
from hireatlas.operators.once import compute_once
from hireatlas.operators.pages import DEFAULT_VOCABULARY, Vocabulary, is_consent_text, page_links

SNIPPET_CHARS = 300  # fixed value: length of the description excerpt of a posting


def excerpt(markup: Column) -> Column:
    return F.left(H.body_text(markup), F.lit(SNIPPET_CHARS))


def jobs_from_json_ld(pages: DataFrame, crawl_ts: str, vocabulary: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Postings from the structured data blocks of pages with their company columns.

    A block may be an object, a list, or an object with a graph list. Broken JSON is skipped.
    """
    carried = ["business_id", "name", "domain", "url"]
    blocks = pages.select(*carried, F.explode_outer(H.ld_json_blocks(F.col("html"))).alias("block"))
    parsed = compute_once(blocks, {"data": F.try_parse_json("block")}).where("data IS NOT NULL")

    def as_items(v: Column, path: str) -> Column:
        return F.try_variant_get(v, path, "array<variant>")

    # A list gives its items; an object gives itself and the items of its graph.
    data = F.col("data")
    items = F.when(
        F.startswith(F.schema_of_variant(data), F.lit("ARRAY")), as_items(data, "$")
    ).otherwise(F.concat(F.array(data), F.coalesce(as_items(data, "$.@graph"), F.array().cast("array<variant>"))))
    rows = parsed.select(*carried, F.explode_outer(items).alias("item")).where("item IS NOT NULL")
    kinds = F.coalesce(F.try_variant_get("item", "$.@type", "array<string>"), F.array(json_text(F.col("item"), "$.@type")))
    rows = rows.where(F.startswith(F.schema_of_variant("item"), F.lit("OBJECT")) & F.coalesce(F.array_contains(kinds, "JobPosting"), F.lit(False)))
    item = F.col("item")
    title = F.coalesce(json_text(item, "$.title"), F.lit(""))
    description = F.coalesce(json_text(item, "$.description"), F.lit(""))
    link = F.coalesce(filled(json_text(item, "$.url")), filled(json_text(item, "$.mainEntityOfPage")), F.col("url"))
    place = F.coalesce(
        filled(json_text(item, "$.jobLocation.address.addressLocality")), filled(json_text(item, "$.jobLocation.address.streetAddress"))
    )
    is_text = F.schema_of_variant(F.try_variant_get(item, "$.employmentType", "variant")) == "STRING"
    return rows.select(
        F.col("business_id").alias("company_business_id"),
        F.col("name").alias("company_name"),
        F.col("domain").alias("company_domain"),
        title.alias("job_title"),
        resolve_url(F.col("url"), link).alias("job_url"),
        place.alias("location_text"),
        F.when(is_text, json_text(item, "$.employmentType")).alias("employment_type"),
        json_text(item, "$.datePosted").alias("posted_date"),
        excerpt(description).alias("description_snippet"),
        F.lit("jsonld").alias("source"),
        detect_tags(F.concat_ws(" ", title, description), vocabulary.tag_rules).alias("tags"),
        F.lit(crawl_ts).alias("crawl_ts"),
    )


def detail_candidates(pages: DataFrame, vocabulary: Vocabulary = DEFAULT_VOCABULARY, max_detail_pages: int | None = None) -> DataFrame:
    """Detail links of list pages with the reason to skip one, if any.

    ``max_detail_pages`` is a crawl budget: with it, only the first links of a list page are looked at.
    """
    v = vocabulary
    found = page_links(pages, v.url_hints, v.text_hints)
    if max_detail_pages is not None:
        found = found.where(F.col("ord") < max_detail_pages)
    reason = F.when(is_listing_url(F.col("target"), v.listing_paths), F.lit("listing_url_skipped")).when(
        is_non_job_url(F.col("target"), v.non_job_paths, v.non_job_queries), F.lit("non_job_url_skipped")
    )
    return found.withColumn("skipped", reason)


def generic_jobs(
    lists: DataFrame, details: DataFrame, crawl_ts: str, vocabulary: Vocabulary = DEFAULT_VOCABULARY, max_detail_pages: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Postings from the detail pages that list pages link to, and the skipped links as error rows.

    Tags come from the whole text of the detail page; only the stored excerpt is short.
    ``lists`` has ``page_id, url, html`` and the company columns; ``details`` are landed pages. A
    detail page is turned into its few posting columns before it meets the links.
    """
    v = vocabulary
    links = detail_candidates(lists, v, max_detail_pages).withColumn("url_key", url_key(F.col("target")))
    texts = compute_once(details, {"url_key": url_key(F.col("url")), "_page": page_parts(F.col("html"), "heading", "title", "body")})
    title = F.coalesce("_page.heading", F.col("url"))
    consent_words = [*v.consent_words, *v.consent_pair]
    texts = compute_once(
        texts,
        {
            "_consent": keyword_places(F.lower(F.concat_ws(" ", "_page.title", "_page.body")), consent_words),
            "_tags": keyword_places(F.lower(F.concat_ws(" ", title, "_page.body")), rule_words(v.tag_rules)),
        },
    )
    snippet = F.nullif(F.left("_page.body", F.lit(SNIPPET_CHARS)), F.lit(""))
    facts = texts.select(
        "url_key",
        F.struct(
            "page_id",
            F.col("url").alias("job_url"),
            title.alias("job_title"),
            snippet.alias("snippet"),
            is_consent_text(F.col("_consent"), v).alias("is_consent"),
            tags_at(F.col("_tags"), v.tag_rules).alias("tags"),
        ).alias("d"),
    )
    facts = facts.groupBy("url_key").agg(F.min_by("d", "d.page_id").alias("d")).select("url_key", "d.*")
    opened = links.where("skipped IS NULL").join(facts.withColumnRenamed("page_id", "detail_id"), "url_key")
    companies = lists.select("page_id", "business_id", "name", "domain")
    # A list page gives one posting per detail page, also when it links to it twice.
    kept = opened.where(~F.col("is_consent")).groupBy("page_id", "url_key").agg(
        F.min_by(F.struct("job_title", "job_url", "snippet", "tags"), "ord").alias("j")
    )
    postings = kept.join(companies, "page_id").select(
        F.col("business_id").alias("company_business_id"),
        F.col("name").alias("company_name"),
        F.col("domain").alias("company_domain"),
        F.col("j.job_title").alias("job_title"),
        F.col("j.job_url").alias("job_url"),
        *[F.lit(None).cast("string").alias(c) for c in ("location_text", "employment_type", "posted_date")],
        F.col("j.snippet").alias("description_snippet"),
        F.lit("generic_html").alias("source"),
        F.col("j.tags").alias("tags"),
        F.lit(crawl_ts).alias("crawl_ts"),
    )
    errors = links.where("skipped IS NOT NULL").select("page_id", "target", F.col("skipped").alias("error")).unionByName(
        opened.where("is_consent").select("page_id", "target", F.lit("cookie_consent").alias("error"))
    )
    return postings, errors


# Payload layouts of the board feeds and where each posting field sits.
FEEDS = {
    "lever": {
        "schema": "array<struct<text:string,hostedUrl:string,applyUrl:string,categories:struct<location:string,commitment:string>,"
        "descriptionPlain:string,description:string,createdAt:string>>",
        "items": None,
        "title": ["text"],
        "url": ["hostedUrl", "applyUrl"],
        "place": "categories.location",
        "employment": "categories.commitment",
        "posted": "createdAt",
        "description": ["descriptionPlain", "description"],
    },
    "greenhouse": {
        "schema": "struct<jobs:array<struct<title:string,absolute_url:string,location:struct<name:string>,updated_at:string,content:string>>>",
        "items": "jobs",
        "title": ["title"],
        "url": ["absolute_url"],
        "place": "location.name",
        "employment": None,
        "posted": "updated_at",
        "description": ["content"],
    },
    "recruitee": {
        "schema": "struct<offers:array<struct<title:string,careers_url:string,url:string,location:string,created_at:string,description:string>>>",
        "items": "offers",
        "title": ["title"],
        "url": ["careers_url", "url"],
        "place": "location",
        "employment": None,
        "posted": "created_at",
        "description": ["description"],
    },
}


def jobs_from_feeds(feeds: DataFrame, crawl_ts: str, vocabulary: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Postings from landed board payloads (``kind, business_id, name, domain, payload``), in one pass.

    Each layout is brought into one common item struct before the items become rows.
    """

    def items_of(layout: dict) -> Column:
        payload = F.from_json("payload", layout["schema"])

        def field(item: Column, path: str | None) -> Column:
            value = item
            for step in (path or "").split("."):
                value = value[step] if step else F.lit(None).cast("string")
            return value

        def first(item: Column, columns: list[str]) -> Column:
            return F.coalesce(*[filled(field(item, c)) for c in columns], F.lit(""))

        return F.transform(
            payload[layout["items"]] if layout["items"] else payload,
            lambda item: F.struct(
                first(item, layout["title"]).alias("title"),
                first(item, layout["url"]).alias("url"),
                field(item, layout["place"]).alias("place"),
                field(item, layout["employment"]).alias("employment"),
                field(item, layout["posted"]).alias("posted"),
                first(item, layout["description"]).alias("description"),
            ),
        )

    items = F.lit(None).cast("array<struct<title:string,url:string,place:string,employment:string,posted:string,description:string>>")
    for kind, layout in FEEDS.items():
        items = F.when(F.col("kind") == kind, items_of(layout)).otherwise(items)
    rows = feeds.where(F.col("kind").isin(list(FEEDS))).select("kind", "business_id", "name", "domain", F.explode_outer(items).alias("item")).where("item IS NOT NULL")
    return rows.select(
        F.col("business_id").alias("company_business_id"),
        F.col("name").alias("company_name"),
        F.col("domain").alias("company_domain"),
        F.col("item.title").alias("job_title"),
        F.col("item.url").alias("job_url"),
        F.col("item.place").alias("location_text"),
        F.col("item.employment").alias("employment_type"),
        F.col("item.posted").alias("posted_date"),
        excerpt(F.col("item.description")).alias("description_snippet"),
        F.col("kind").alias("source"),
        detect_tags(F.concat_ws(" ", "item.title", "item.description"), vocabulary.tag_rules).alias("tags"),
        F.lit(crawl_ts).alias("crawl_ts"),
    )
