"""URL parts, classes and relative resolution."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hireatlas.functions.text import contains_any, strip, usable
from hireatlas import rules


def with_scheme(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("://")), c).otherwise(F.concat(F.lit("https://"), c))


def authority(url: Column) -> Column:
    """Host with port of an absolute URL; empty text when there is none."""
    return F.regexp_extract(url, r"^[^:/?#]+://([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[^:/?#]+:)?(?://[^/?#]*)?([^?#]*)", 1)


def query_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def clean_domain(c: Column | str) -> Column:
    """Host of a URL or bare domain, keeping port, ``www.`` and case; empty text for blank input."""
    text = usable(c)
    return F.coalesce(strip(authority(with_scheme(text))), F.lit(""))


def url_key(url: Column) -> Column:
    """Equality key for landed pages: no scheme, no fragment, no trailing slash, host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(strip(url), r"^[^:/?#]+://", ""), r"#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[^/?]*", 0))
    rest = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*(.*)$", 1), r"/$", "")
    return F.concat(host, rest)


def host_is(host: Column, domain: Column) -> Column:
    """True for the domain itself and for its sub-domains."""
    return (host != "") & (domain != "") & ((host == domain) | F.endswith(host, F.concat(F.lit("."), domain)))


def is_first_party(url: Column, domain: Column) -> Column:
    host = F.lower(authority(with_scheme(F.coalesce(url, F.lit("")))))
    return F.coalesce(host_is(host, F.lower(domain)), F.lit(False))


def is_ats_host(url: Column) -> Column:
    host = F.lower(authority(with_scheme(F.coalesce(url, F.lit("")))))
    found = F.lit(False)
    for name in rules.ATS_HOSTS:
        found = found | host_is(host, F.lit(name))
    return found


def is_listing_url(url: Column, paths=rules.LISTING_PATHS) -> Column:
    trimmed = F.rtrim(path_of(url), F.lit("/"))
    return F.when(trimmed == "", F.lit("/")).otherwise(trimmed).isin(list(paths))


def is_non_job_url(url: Column, path_hints=rules.NON_JOB_PATH_HINTS, query_hints=rules.NON_JOB_QUERY_HINTS) -> Column:
    return contains_any(F.lower(path_of(url)), path_hints) | contains_any(F.lower(query_of(url)), query_hints)


def place_id(maps_url: Column | str) -> Column:
    """Place id of a map link on an allowed host: a query key, else the ``!1s`` segment."""
    url = strip(maps_url)
    query = F.concat(F.lit("&"), query_of(url))

    def by_key(key: str) -> Column:
        return F.nullif(F.regexp_extract(query, f"&{key}=([^&]*)", 1), F.lit(""))

    segment = F.nullif(F.regexp_extract(url, r"!1s([^!]+)", 1), F.lit(""))
    found = F.coalesce(
        *[F.try_url_decode(by_key(key)) for key in rules.PLACE_ID_KEYS],
        F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))),
    )
    return F.when(maps_host_allowed(url), found)


def maps_host_allowed(url: Column) -> Column:
    return authority(strip(url)).isin(rules.MAPS_HOSTS)


def _drop_dots(path: Column) -> Column:
    """Apply ``.`` and ``..`` segments of an absolute path."""
    segments = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    last = F.element_at(segments, -1)
    kept = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
        .when(s == ".", done)
        .otherwise(F.concat(done, F.array(s))),
    )
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    ends_in_dir = last.isin(".", "..") & (F.size(kept) > 0)
    return F.when(ends_in_dir, F.concat(joined, F.lit("/"))).otherwise(joined)


def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of a link found on the page ``base``."""
    scheme = F.regexp_extract(base, r"^([^:/?#]+):", 1)
    root = F.concat(scheme, F.lit("://"), authority(base))
    base_path = F.when(path_of(base) == "", F.lit("/")).otherwise(path_of(base))
    folder = F.regexp_extract(base_path, r"^(.*/)", 1)
    no_fragment = F.regexp_extract(base, r"^[^#]*", 0)
    link = strip(href)
    link_path = F.regexp_extract(link, r"^[^?#]*", 0)
    tail = F.regexp_extract(link, r"^[^?#]*(.*)$", 1)
    has_dots = F.rlike(F.concat(F.lit("/"), link_path, F.lit("/")), F.lit(r"/\.\.?/"))

    def settle(path: Column) -> Column:
        return F.when(has_dots, _drop_dots(path)).otherwise(path)

    return (
        F.when(link == "", base)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("#")), F.concat(no_fragment, link))
        .when(F.startswith(link, F.lit("?")), F.concat(root, path_of(base), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, settle(link_path), tail))
        .otherwise(F.concat(root, settle(F.concat(folder, link_path)), tail))
    )
