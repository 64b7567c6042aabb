"""Text, links and embedded blocks of HTML as columns; see `markup` for what they hold.

Each function reads one part. An operator that needs several takes them from one `page_parts` column, so that a page is
tokenized once.
"""

from __future__ import annotations

from pyspark.sql import Column

from hireatlas.functions.markup import page_parts


def visible_text(html: Column) -> Column:
    """Page text without scripts, styles and noscript blocks."""
    return page_parts(html, "text")["text"]


def body_text(html: Column) -> Column:
    """Page text that keeps noscript blocks, as the consent and job-signal tests read it."""
    return page_parts(html, "body")["body"]


def title_text(html: Column) -> Column:
    return page_parts(html, "title")["title"]


def first_heading(html: Column) -> Column:
    """Text of the first ``h1``, null when the page has none."""
    return page_parts(html, "heading")["heading"]


def links(html: Column) -> Column:
    """``array<struct<href,text>>`` of the anchors with an address, in document order; text in lower case."""
    return page_parts(html, "links")["links"]


def ld_json_blocks(html: Column) -> Column:
    """Bodies of the ``application/ld+json`` scripts."""
    return page_parts(html, "data_blocks")["data_blocks"]


def sitemap_locations(xml: Column) -> Column:
    """The addresses of a sitemap, in order; blank ones are left out."""
    return page_parts(xml, "locations")["locations"]
