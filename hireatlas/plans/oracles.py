"""Independent SQL for the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

import re

from hireatlas import rules
from hireatlas.plans.bindings import BINDINGS, SITE_PATHS, TAG_RULES, VOCABULARY, bound_sql

AS_OF = "TIMESTAMP '2001-08-02 00:00:00'"
CUT = "TIMESTAMP '2000-06-01 00:00:00'"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]::VARCHAR[]"


def hav(lat1, lon1, lat2, lon2) -> str:
    return (
        f"(CASE WHEN {lat1} + {lon1} + {lat2} + {lon2} IS NOT NULL THEN 2 * 6371.0088e0 * asin(sqrt(least(1.0, pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1}))"
        f" * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)))) END)"
    )


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def filled(x: str) -> str:
    return f"nullif({strip(x)}, '')"


def usable(x: str) -> str:
    return f"(CASE WHEN lower({strip(x)}) IN ('', 'nan', 'none', 'null') THEN NULL ELSE {strip(x)} END)"


def fold(x: str) -> str:
    return f"translate(lower({strip(f'coalesce({x}, {chr(39)*2})')}), 'äöå', 'aoa')"


def tag_parts(x: str) -> str:
    return (
        f"list_filter(list_transform(string_split(replace(coalesce({x}, ''), ';', ','), ','), lambda t: lower({strip('t')})), lambda t: t <> '')"
    )


def sorted_tags(x: str) -> str:
    return f"list_sort(list_distinct({tag_parts(x)}))"


def in_order_distinct(listing: str) -> str:
    return f"list_filter({listing}, lambda e, i: list_position({listing}, e) = i)"


def any_word(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")" if words else "false"


def detect(text: str, rule_set) -> str:
    cases = ", ".join(f"CASE WHEN {any_word(f'lower({text})', words)} THEN {q(tag)} END" for tag, words in rule_set.items())
    return f"list_filter([{cases}], lambda t: t IS NOT NULL)"


def found_words(text: str, words) -> str:
    return f"list_filter({lst(words)}, lambda w: contains({text}, w))"


def snippets(text: str, words, limit: int) -> str:
    parts = ", ".join(
        f"CASE WHEN instr(lower({text}), {q(w)}) > 0 THEN {strip(f'substr({text}, greatest(instr(lower({text}), {q(w)}) - 80, 1), least(length({text}), instr(lower({text}), {q(w)}) + 79) - greatest(instr(lower({text}), {q(w)}) - 80, 1) + 1)')} END"
        for w in words
    )
    listing = f"list_filter([{parts}], lambda s: s IS NOT NULL AND s <> '')"
    return f"list_slice({in_order_distinct(listing)}, 1, {limit})"


def authority(u: str) -> str:
    return f"regexp_extract({u}, '^[^:/?#]+://([^/?#]*)', 1)"


def with_scheme(u: str) -> str:
    return f"(CASE WHEN contains({u}, '://') THEN {u} ELSE 'https://' || {u} END)"


def path_of(u: str) -> str:
    return f"regexp_extract({u}, '^([^:/?#]+:)?(//[^/?#]*)?([^?#]*)', 3)"


def query_of(u: str) -> str:
    return f"regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1)"


def clean_domain(x: str) -> str:
    return f"coalesce({strip(authority(with_scheme(usable(x))))}, '')"


def url_key(u: str) -> str:
    bare = f"regexp_replace(regexp_replace({strip(u)}, '^[^:/?#]+://', ''), '#.*$', '')"
    return f"(lower(regexp_extract({bare}, '^[^/?]*', 0)) || regexp_replace(regexp_extract({bare}, '^[^/?]*(.*)$', 1), '/$', ''))"


def entities(x: str) -> str:
    """The references that occur in the corpus, each spelled out; the ampersand comes last."""
    for name, char in (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        x = f"replace({x}, '&{name};', {q(char)})"
    return x


def node_text(x: str) -> str:
    """Cut at every '<': a piece that begins like a tag starts behind its first '>', any other one keeps its '<'."""
    bare = f"regexp_replace({x}, '(?s)<!--.*?(?:-->|\\z)', chr(1), 'g')"
    piece = (
        "CASE WHEN i = 1 THEN p WHEN contains(p, '>') AND (p[1] BETWEEN 'A' AND 'Z' OR p[1] BETWEEN 'a' AND 'z' OR p[1] IN ('/', '!', '?'))"
        " THEN chr(1) || substr(p, strpos(p, '>') + 1) ELSE '<' || p END"
    )
    marked = f"replace(array_to_string(list_transform(string_split({bare}, '<'), lambda p, i: {piece}), ''), '&nbsp;', chr(160))"
    nodes = f"list_transform(string_split({marked}, chr(1)), lambda n: {strip('n')})"
    return strip(entities(f"array_to_string(list_filter({nodes}, lambda n: n <> ''), ' ')"))


def without(x: str, names) -> str:
    for n in names:
        x = f"regexp_replace({x}, '(?is)<{n}\\b.*?(?:</{n}\\s*>|\\z)', chr(1), 'g')"
    return x


def visible(x: str) -> str:
    return node_text(without(x, ["script", "style", "noscript"]))


def body(x: str) -> str:
    return node_text(without(x, ["script", "style"]))


def title(x: str) -> str:
    return node_text(f"regexp_extract({x}, '(?is)<title\\b[^>]*>(.*?)</title\\s*>', 1)")


def joined(x: str) -> str:
    return f"array_to_string({x}, '|')"


HOUSING = "translate(lower(" + strip("coalesce({0}, '')") + "), 'öäå', 'oaa')"


def housing(name: str) -> str:
    pattern = "|".join(f"(?:{p})" for p in rules.HOUSING_NAME_PATTERNS)
    return f"regexp_matches({HOUSING.format(name)}, {q(pattern)})"


def industry(code: str) -> str:
    """Longest prefix by a correlated lookup in the rule list."""
    rows = ", ".join(
        f"({i}, {q(g)}, {q(p)})" for i, (g, ps) in enumerate(rules.INDUSTRY_GROUPS.items()) for p in ps
    )
    digits = f"regexp_replace(coalesce({code}, ''), '[^0-9]', '', 'g')"
    return (
        f"coalesce((SELECT r.g FROM (VALUES {rows}) r(i, g, p) WHERE starts_with({digits}, r.p)"
        f" ORDER BY length(r.p) DESC, r.i LIMIT 1), 'other')"
    )


def excluded(form: str, name: str) -> str:
    forms = ", ".join(q(f) for f in rules.HOUSING_FORMS)
    up = f"upper({strip(f'coalesce({form}, {chr(39)*2})')})"
    return (
        f"CASE WHEN translate({up}, 'ÖÄÅÕ', 'OAAO') IN ({forms}) THEN 'company_form:' || {up}"
        f" WHEN {housing(name)} THEN 'name_match:housing' END"
    )


def gate(line: str, allow, deny, part: str) -> str:
    cases = []
    for w in deny:
        cases.append((w, {"pass": "false", "reason": q(f"blacklist:{w}"), "hard": "true"}))
    for w in allow:
        cases.append((w, {"pass": "true", "reason": q(f"whitelist:{w}"), "hard": "false"}))
    rest = {"pass": "false", "reason": "'not_in_whitelist'", "hard": "false"}
    whens = " ".join(f"WHEN contains(lower(coalesce({line}, '')), {q(w)}) THEN {v[part]}" for w, v in cases)
    return f"(CASE {whens} ELSE {rest[part]} END)"


def normal(x: str) -> str:
    text = f"regexp_replace({strip(f'lower(coalesce({x}, {chr(39)*2}))')}, '\\s+', ' ', 'g')"
    return f"replace(replace({text}, ', finland', ''), ', suomi', '')"


FINGERPRINT = "md5(" + " || chr(1) || ".join(normal(c) for c in ("job_title", "location_text", "posted_date", "company_domain")) + ")"
POSTED = (
    "(CASE WHEN regexp_matches(posted_date, '^[0-9]{12,13}$') THEN epoch_ms(try_cast(posted_date AS BIGINT))"
    " WHEN NOT regexp_matches(posted_date, '^[0-9]+$') THEN try_cast(posted_date AS TIMESTAMP) END)"
)
V = VOCABULARY
LIM = V.cookie_limits


def host_hit(text: str, name: str) -> str:
    escaped = name.replace(".", "\\.")
    return f"regexp_matches({text}, '(?:^|[^A-Za-z0-9\\-]){escaped}(?:[^A-Za-z0-9\\-]|$)')"


def slug(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(url, {q(pattern)}) THEN regexp_extract(url, {q(pattern)}, 1) END"


ATS_KIND = (
    f"CASE WHEN {host_hit('url', 'lever.co')} OR {host_hit('html', 'lever.co')} THEN 'lever'"
    " WHEN contains(url, 'greenhouse.io') OR contains(html, 'boards.greenhouse.io') THEN 'greenhouse'"
    " WHEN contains(url, 'recruitee.com') OR contains(html, 'recruitee.com') THEN 'recruitee'"
    " WHEN contains(url, 'teamtailor') OR contains(html, 'teamtailor') THEN 'teamtailor' END"
)
ANSWER_GATE_THIN = "(len(s) < 2 OR len(u) = 0)"


def verdict_ctes(pages: str) -> dict[str, str]:
    """Page features and verdict over a CTE with page_id, url, html."""
    signal = f"(contains(lower(html), {q(V.structured_marker)}) OR {any_word('low_body', V.job_phrases)})"
    return {
        f"{pages}_feat": f"SELECT page_id, url, html, {title('html')} AS title, {visible('html')} AS text, lower({body('html')}) AS low_body, {ATS_KIND} AS kind FROM {pages}",
        f"{pages}_found": f"SELECT *, {snippets('text', V.evidence, 3)} AS found, contains(lower(html), {q(V.structured_marker)}) AS structured, {signal} AS has_signal FROM {pages}_feat",
        f"{pages}_verdict": "SELECT *, CASE WHEN kind IS NOT NULL OR structured OR (has_signal AND len(found) >= 2) THEN 'yes' ELSE 'unclear' END AS signal,"
        " CASE WHEN kind IS NOT NULL THEN 0.9e0 WHEN structured THEN 0.8e0 WHEN has_signal AND len(found) >= 2 THEN 0.7e0 WHEN has_signal THEN 0.2e0 ELSE 0e0 END AS confidence,"
        " CASE WHEN kind IS NOT NULL THEN 'ats:' || kind WHEN structured THEN 'jobposting_structured_data' WHEN has_signal AND len(found) >= 2 THEN 'job_signal_keywords' WHEN has_signal THEN 'weak_job_signal' ELSE '' END AS evidence,"
        " CASE WHEN kind IS NOT NULL THEN ['ATS detected: ' || kind, 'ATS job board link found'] WHEN structured THEN ['JobPosting structured data found', 'Title: ' || title] WHEN has_signal AND len(found) >= 2 THEN found ELSE []::VARCHAR[] END AS ev_snippets,"
        " CASE WHEN kind IS NOT NULL OR structured OR (has_signal AND len(found) >= 2) THEN [url] ELSE []::VARCHAR[] END AS ev_urls"
        f" FROM {pages}_found",
        f"{pages}_wall": f"SELECT *, {found_words(chr(108) + 'ow_all', V.cookie_words)} AS matches FROM (SELECT page_id, url, title, text, lower(title || ' ' || text) AS low_all FROM {pages}_feat)",
        f"{pages}_walls": "SELECT *, len(matches) AS hits, least(1.0e0, len(matches) / 5e0) AS score,"
        f" ((len(matches) >= {LIM['hits_min']} AND least(1.0e0, len(matches) / 5e0) >= {LIM['score_min']} AND length(text) < {LIM['text_max_len']}) OR len(matches) >= {LIM['hits_hard']}) AS is_wall,"
        " list_filter(["
        + ", ".join(f"CASE WHEN {any_word('low_all', ws)} THEN {q(n)} END" for n, ws in V.cookie_signals.items())
        + f"], lambda x: x IS NOT NULL) AS signals FROM {pages}_wall",
    }


CTES: dict[str, str] = {name: bound_sql(name) for name in BINDINGS}
CTES["companies"] = f"SELECT *, {industry('main_business_line')} AS industry FROM ({bound_sql('companies')})"
CTES |= {
    "near": f"SELECT c.business_id, s.station_name, {hav('s.lat', 's.lon', 'c.lat', 'c.lon')} AS km, row_number() OVER (PARTITION BY c.business_id ORDER BY {hav('s.lat', 's.lon', 'c.lat', 'c.lon')}, s.ord) AS rn FROM companies c, stations s WHERE c.lat IS NOT NULL AND c.lon IS NOT NULL",
    "shortlist": "SELECT c.*, n.station_name AS nearest_station, n.km AS distance_km FROM companies c LEFT JOIN near n ON n.business_id = c.business_id AND n.rn = 1",
    "edits": "SELECT * EXCLUDE (listed) FROM overlay WHERE listed",
    "new_edits": "SELECT * EXCLUDE (listed) FROM edits_a WHERE listed",
    "new_edits_all": "SELECT * EXCLUDE (listed) FROM edits_b WHERE listed UNION ALL SELECT * EXCLUDE (listed) FROM edits_a WHERE listed AND business_id NOT IN (SELECT business_id FROM edits_b WHERE listed)",
    "new_edits_b": "SELECT * EXCLUDE (listed) FROM edits_b WHERE listed",
    "effective": (
        "SELECT c.* EXCLUDE (status, hide_flag, note), coalesce(o.status, c.status) AS status, coalesce(o.hide_flag, c.hide_flag, false) AS hide_flag,"
        " coalesce(o.note, c.note) AS note, CASE WHEN trim(coalesce(o.industry_override, '')) <> '' THEN o.industry_override ELSE c.industry END AS industry_effective,"
        f" list_sort(list_distinct(list_filter(list_concat({sorted_tags('c.tags')}, {sorted_tags('o.tags_add')}), lambda t: NOT list_contains({sorted_tags('o.tags_remove')}, t)))) AS tags_effective"
        " FROM shortlist c LEFT JOIN edits o ON o.business_id = c.business_id"
    ),
    "jobs": f"SELECT *, {detect(chr(106) + 'ob_title || chr(32) || description_snippet', TAG_RULES)} AS tags, {FINGERPRINT} AS fp FROM jobs_raw",
    "by_url": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_url ORDER BY ord) AS r1 FROM jobs) WHERE r1 = 1",
    "distinct_jobs": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY company_business_id, fp ORDER BY ord) AS r2 FROM by_url) WHERE r2 = 1",
    "known": f"SELECT job_url, fp FROM jobs WHERE o_orderdate < {CUT}",
    "flagged": "SELECT *, NOT (job_url IN (SELECT job_url FROM known)) AND NOT (fp IN (SELECT fp FROM known)) AS is_new FROM distinct_jobs",
    "new_jobs": "SELECT * FROM flagged WHERE is_new",
    "new_counts": "SELECT company_business_id AS business_id, count(*) AS n FROM new_jobs GROUP BY 1",
    "activity": (
        "SELECT company_business_id AS business_id, count(*) AS job_count_total,"
        f" count(*) FILTER ({POSTED} >= {AS_OF} - INTERVAL 900 DAY) AS job_count_last_30d, count(*) FILTER (is_new) AS job_count_new_since_last, true AS recruiting_active, "
        + ", ".join(f"count(*) FILTER (list_contains(tags, {q(t)})) AS tag_count_{t}" for t in rules.ACTIVITY_TAGS)
        + " FROM flagged GROUP BY 1"
    ),
    "err": "SELECT domain, split_part(error, ':', 1) AS error, count(*) AS n FROM fetch_log WHERE error IS NOT NULL GROUP BY 1, 2",
    "err_text": "SELECT domain, string_agg(error || ':' || n, ';' ORDER BY n DESC, error) AS errors_top, list(error) AS kinds FROM err GROUP BY 1",
    "log_stats": (
        "SELECT l.domain, count(*) FILTER (error IS NULL AND status_code < 400) AS pages_fetched, CAST(sum(jobs) AS BIGINT) AS jobs_found,"
        " (SELECT string_agg(DISTINCT extractor, ';' ORDER BY extractor) FROM fetch_log x WHERE x.domain = l.domain) AS extractor_used, count(error) AS errors_count,"
        " arg_min(skipped_reason, seq) FILTER (skipped_reason IS NOT NULL) AS skipped_reason,"
        " arg_min(error, seq) FILTER (error IN ('robots_disallow_all', 'robots_disallow_url')) AS robots_rule_hit,"
        " arg_min(url, seq) FILTER (error IN ('robots_disallow_all', 'robots_disallow_url')) AS first_blocked_url,"
        " arg_min(ats_detected, seq) FILTER (ats_detected IS NOT NULL) AS ats_detected, count(*) FILTER (ats_fetch_ok) > 0 AS ats_fetch_ok, arg_min(ats_fetch_reason, seq) FILTER (ats_fetch_reason IS NOT NULL) AS ats_fetch_reason"
        " FROM fetch_log l GROUP BY 1"
    ),
    "stats": (
        "SELECT s.*, e.errors_top, CASE WHEN jobs_found > 0 THEN 'ok'"
        " WHEN coalesce(skipped_reason IN ('robots_disallow_all', 'robots_disallow_url', 'robots_unavailable', 'http_403'), false) OR coalesce(list_contains(kinds, 'http_403'), false) THEN 'blocked'"
        " WHEN coalesce(list_contains(kinds, 'cookie_consent'), false) THEN 'consent_gate'"
        " WHEN coalesce(skipped_reason IN ('timeout', 'dns', 'base_fetch_failed'), false) OR coalesce(list_has_any(kinds, ['timeout', 'dns', 'max_retries_exceeded']), false) THEN 'technical_fail'"
        " ELSE 'no_signal' END AS status FROM log_stats s LEFT JOIN err_text e ON e.domain = s.domain"
    ),
    "sites": f"SELECT 'H-' || domain AS business_id, 'Site ' || domain AS name, domain, arg_min(url, page_id) AS website_url, min(page_id) AS ord FROM (SELECT *, {authority('url')} AS domain FROM site_pages) GROUP BY domain",
    "page_parts": f"SELECT page_id, url, {authority('url')} AS host, {path_of('url')} AS path, {query_of('url')} AS qs FROM site_pages",
    "access": (
        "SELECT host, page_id AS ord, substr(path, 1, 5) AS prefix, page_id % 3 = 0 AS allow FROM page_parts WHERE page_id % 5 = 0"
    ),
    "states": "SELECT host, CASE WHEN min(page_id) % 7 = 3 THEN 'disallow_all' WHEN min(page_id) % 7 = 5 THEN 'unreachable' END AS state FROM page_parts GROUP BY 1",
    "maps": (
        "SELECT page_id, url, html, CASE page_id % 6 WHEN 0 THEN 'https://www.google.com/maps?place_id=PL' || page_id || '&x=1'"
        " WHEN 1 THEN 'https://maps.google.com/?q=a&query_place_id=Q%3A' || page_id WHEN 2 THEN 'https://www.google.com/maps/place/x/data=!4m5!1s0x' || page_id || '%3A0x1!8m2'"
        " WHEN 3 THEN 'https://maps.example.com/?place_id=PL' || page_id WHEN 4 THEN 'https://goo.gl/maps/abc' ELSE ' https://google.com/maps?placeid=W' || page_id || '&place_id= ' END AS maps_url,"
        " CASE page_id % 6 WHEN 0 THEN 'PL' || page_id WHEN 1 THEN 'Q:' || page_id WHEN 2 THEN '0x' || page_id || ':0x1' WHEN 5 THEN 'W' || page_id END AS place_id,"
        " page_id % 6 <> 3 AS host_ok FROM site_pages"
    ),
    "gated": (
        f"SELECT a.answer_id, a.business_key, a.turn, lower(json_extract_string(j, '$.hiring_signal')) AS signal, coalesce(CAST(json_extract(j, '$.confidence') AS DOUBLE), 0) AS confidence,"
        " coalesce(json_extract_string(j, '$.evidence'), '') AS evidence, coalesce(json_extract_string(j, '$.evidence_snippets[*]'), []) AS raw_s, coalesce(json_extract_string(j, '$.evidence_urls[*]'), []) AS raw_u"
        " FROM (SELECT *, try_cast(nullif(regexp_extract(answer, '(?s)\\{.*\\}', 0), '') AS JSON) AS j FROM model_answers) a WHERE j IS NOT NULL"
    ),
    "gated2": f"SELECT *, list_filter(list_transform(raw_s, lambda x: {strip('x')}), lambda x: x <> '') AS s, list_filter(list_transform(raw_u, lambda x: {strip('x')}), lambda x: x <> '') AS u FROM gated",
    "gated3": (
        "SELECT *, signal IN ('yes', 'no') AS decided, len(list_filter(s, lambda x: " + any_word("lower(x)", rules.EVIDENCE_KEYWORDS) + ")) > 0 AS pro,"
        " len(list_filter(s, lambda x: " + any_word("lower(x)", rules.NEGATIVE_KEYWORDS) + ")) > 0 AS con FROM gated2"
    ),
    "gate_out": (
        f"SELECT *, decided AND ({ANSWER_GATE_THIN} OR (signal = 'yes' AND NOT pro) OR (signal = 'no' AND NOT con)) AS failed FROM gated3"
    ),
    "verdicts": (
        f"SELECT answer_id, business_key, CASE WHEN failed THEN 'unclear' ELSE signal END AS signal, CASE WHEN failed THEN least(confidence, 0.2e0) ELSE confidence END AS confidence,"
        f" CASE WHEN failed AND {ANSWER_GATE_THIN} THEN 'insufficient_evidence' WHEN failed THEN 'generic_evidence' ELSE evidence END AS evidence,"
        " CASE WHEN failed THEN []::VARCHAR[] WHEN decided THEN s[:6] ELSE raw_s END AS es, CASE WHEN failed THEN []::VARCHAR[] WHEN decided THEN u ELSE raw_u END AS eu FROM gate_out"
    ),
    "ats_pages": (
        "SELECT page_id, CASE page_id % 8 WHEN 0 THEN 'https://jobs.lever.co/co' || page_id || '/x' WHEN 1 THEN 'https://boards.greenhouse.io/co' || page_id WHEN 2 THEN 'https://co' || page_id || '.recruitee.com/o/1'"
        " WHEN 3 THEN 'https://co' || page_id || '.teamtailor.com/jobs' WHEN 4 THEN 'https://www.clever.com/page' ELSE url END AS url,"
        " html || CASE page_id % 11 WHEN 5 THEN '<a href=''https://boards.greenhouse.io/x''>' WHEN 6 THEN '<script src=''https://hire.lever.co/x.js''></script>' ELSE '' END AS html FROM site_pages"
    ),
    "scan_pages": "SELECT page_id, url, html || CASE page_id % 11 WHEN 5 THEN '<a href=''https://boards.greenhouse.io/x''>' ELSE '' END AS html FROM site_pages",
    "page_keys": f"SELECT {url_key('url')} AS url_key, min(page_id) AS page_id FROM site_pages GROUP BY 1",
    "anchors": (
        "SELECT page_id, url, unnest(a) AS anchor, generate_subscripts(a, 1) AS i FROM (SELECT page_id, url, list_filter(string_split(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '<a ')[2:], lambda p: starts_with(p, 'href=') AND contains(p, '>')) AS a FROM site_pages)"
    ),
    "hrefs": "SELECT page_id, url, i, replace(regexp_extract(anchor, 'href=\"([^\"]*)\"', 1), '&amp;', '&') AS href, lower(split_part(split_part(anchor, '>', 2), '<', 1)) AS text FROM anchors",
    "targets": f"SELECT page_id, i, href, text, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || href AS target FROM hrefs",
}
CTES |= verdict_ctes("site_pages")
CTES |= verdict_ctes("ats_pages")
CTES |= verdict_ctes("scan_pages")


def scan_ctes(prefix: str, targets: str, paths, answered: bool = False) -> dict[str, str]:
    """Candidates, gate, verdicts and per-company summary over a target CTE."""
    said = (
        "v.confidence, v.evidence, v.es, v.eu,"
        if answered
        else "CASE WHEN v.signal = 'yes' THEN v.confidence ELSE 0 END AS confidence, CASE WHEN v.signal = 'yes' THEN v.evidence ELSE '' END AS evidence,"
        " CASE WHEN v.signal = 'yes' THEN v.ev_snippets ELSE []::VARCHAR[] END AS es, CASE WHEN v.signal = 'yes' THEN v.ev_urls ELSE [v.url] END AS eu,"
    )
    verdicts = "scan_pages_answered" if answered else "scan_pages_verdict"
    urls = ["site", f"'https://' || domain || {q(paths[0])}", "'https://' || domain", *[f"'https://' || domain || {q(p)}" for p in paths[1:]]]
    listing = f"list_filter([{', '.join(urls)}], lambda x: x IS NOT NULL)"
    p = prefix
    return {
        f"{p}_cand": f"SELECT business_id, {in_order_distinct(listing)} AS urls FROM (SELECT *, {with_scheme(usable('website_url'))} AS site FROM {targets})",
        f"{p}_urls": f"SELECT business_id, unnest(urls) AS url, generate_subscripts(urls, 1) - 1 AS ord FROM {p}_cand",
        f"{p}_held": f"SELECT u.*, k.page_id FROM (SELECT *, {url_key('url')} AS url_key FROM {p}_urls) u LEFT JOIN page_keys k ON k.url_key = u.url_key",
        f"{p}_paths": f"SELECT *, lower({authority('url')}) AS host, (CASE WHEN {path_of('url')} = '' THEN '/' ELSE {path_of('url')} END) || (CASE WHEN {query_of('url')} <> '' THEN '?' || {query_of('url')} ELSE '' END) AS target FROM {p}_held",
        f"{p}_gated": (
            "SELECT c.*, CASE WHEN s.state = 'unreachable' THEN 'robots_unavailable' WHEN s.state = 'disallow_all' THEN 'robots_disallow_all'"
            " WHEN (SELECT arg_min(a.allow, a.ord) FROM access a WHERE a.host = c.host AND starts_with(c.target, a.prefix)) = false THEN 'robots_disallow_url' ELSE '' END AS skip_reason"
            f" FROM {p}_paths c LEFT JOIN states s ON s.host = c.host"
        ),
        f"{p}_judged": (
            "SELECT g.business_id, g.ord, g.skip_reason, g.skip_reason = '' AND g.page_id IS NOT NULL AS fetched, CASE WHEN g.skip_reason = '' AND g.page_id IS NOT NULL THEN v.url ELSE g.url END AS address,"
            f" v.signal, {said}"
            " w.is_wall, w.hits, w.score, w.matches, w.signals"
            f" FROM {p}_gated g LEFT JOIN {verdicts} v ON v.page_id = g.page_id LEFT JOIN scan_pages_walls w ON w.page_id = g.page_id"
        ),
        f"{p}_lists": (
            "SELECT business_id, string_agg(address, ';' ORDER BY ord) AS checked_urls,"
            " coalesce(string_agg(CASE WHEN skip_reason <> '' THEN address || ':' || skip_reason WHEN NOT fetched THEN address || ':fetch_failed' WHEN is_wall THEN address || ':cookie_wall:' || hits || ':' || printf('%.2f', score) || ':' || array_to_string(list_slice(matches, 1, 5), ',') END, ';' ORDER BY ord), '') AS errors,"
            " coalesce(string_agg(CASE WHEN skip_reason <> '' THEN address || ':' || skip_reason WHEN NOT fetched THEN address || ':fetch_failed' END, '|' ORDER BY ord), '') AS safe_errors,"
            " coalesce(string_agg(DISTINCT CASE WHEN skip_reason <> '' THEN skip_reason WHEN NOT fetched THEN 'fetch_failed' END, ';' ORDER BY CASE WHEN skip_reason <> '' THEN skip_reason WHEN NOT fetched THEN 'fetch_failed' END), '') AS skipped,"
            " count(*) FILTER (fetched) AS pages_fetched, count(*) FILTER (fetched AND NOT is_wall) > 0 AS results_found, count(*) FILTER (fetched AND is_wall) > 0 AS wall"
            f" FROM {p}_judged GROUP BY 1"
        ),
        f"{p}_best": (
            "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY CASE signal WHEN 'yes' THEN 2 WHEN 'unclear' THEN 1 ELSE 0 END DESC, confidence DESC, ord) AS rn"
            f" FROM {p}_judged WHERE fetched AND NOT is_wall) WHERE rn = 1"
        ),
    }


CTES |= scan_ctes("site", "sites", SITE_PATHS)
# The last answer of each page, gated after its gaps are filled from the page.
CTES["page_answers"] = (
    "SELECT * FROM (SELECT answer_id // 100 AS page_id, lower(json_extract_string(j, '$.hiring_signal')) AS signal, coalesce(CAST(json_extract(j, '$.confidence') AS DOUBLE), 0) AS confidence,"
    " coalesce(json_extract_string(j, '$.evidence'), '') AS evidence, CASE WHEN json_type(j, '$.evidence_snippets') IS NOT NULL THEN json_extract_string(j, '$.evidence_snippets[*]') END AS raw_s,"
    " coalesce(json_extract_string(j, '$.evidence_urls[*]'), []) AS raw_u, row_number() OVER (PARTITION BY answer_id // 100 ORDER BY turn DESC) AS rn"
    " FROM (SELECT *, try_cast(nullif(regexp_extract(answer, '(?s)\\{.*\\}', 0), '') AS JSON) AS j FROM model_answers) WHERE j IS NOT NULL) WHERE rn = 1"
)
CTES["page_answers_filled"] = (
    f"SELECT a.page_id, a.signal, a.confidence, a.evidence, coalesce(a.raw_s, f.found) AS rs, CASE WHEN len(a.raw_u) = 0 THEN [f.url] ELSE a.raw_u END AS ru"
    " FROM page_answers a JOIN scan_pages_found f ON f.page_id = a.page_id"
)
CTES["page_answers_judged"] = (
    "SELECT *, signal IN ('yes', 'no') AS decided, len(s) < 2 OR len(u) = 0 AS thin, len(list_filter(s, lambda x: " + any_word("lower(x)", V.evidence) + ")) > 0 AS pro,"
    " len(list_filter(s, lambda x: " + any_word("lower(x)", V.negative) + f")) > 0 AS con FROM (SELECT *, list_filter(list_transform(rs, lambda x: {strip('x')}), lambda x: x <> '') AS s,"
    f" list_filter(list_transform(ru, lambda x: {strip('x')}), lambda x: x <> '') AS u FROM page_answers_filled)"
)
CTES["page_answers_gated"] = "SELECT *, decided AND (thin OR (signal = 'yes' AND NOT pro) OR (signal = 'no' AND NOT con)) AS failed FROM page_answers_judged"
CTES["scan_pages_answered"] = (
    "SELECT v.page_id, v.url, CASE WHEN own THEN v.signal WHEN failed THEN 'unclear' ELSE a.signal END AS signal, CASE WHEN own THEN v.confidence WHEN failed THEN least(a.confidence, 0.2e0) ELSE a.confidence END AS confidence,"
    " CASE WHEN own THEN v.evidence WHEN failed AND thin THEN 'insufficient_evidence' WHEN failed THEN 'generic_evidence' ELSE a.evidence END AS evidence,"
    " CASE WHEN own THEN v.ev_snippets WHEN failed THEN []::VARCHAR[] WHEN decided THEN s[:6] ELSE rs END AS es, CASE WHEN own THEN v.ev_urls WHEN failed THEN []::VARCHAR[] WHEN decided THEN u ELSE ru END AS eu"
    " FROM (SELECT v.*, v.signal = 'yes' OR a.page_id IS NULL AS own FROM scan_pages_verdict v LEFT JOIN page_answers a ON a.page_id = v.page_id) v LEFT JOIN page_answers_gated a ON a.page_id = v.page_id"
)
CTES |= scan_ctes("ans", "sites", SITE_PATHS, answered=True)
CTES |= {
    "lookups": "SELECT place_id, max(CASE WHEN page_id % 5 <> 2 THEN url END) AS website_url, max(CASE WHEN page_id % 13 = 1 THEN 'http_500' END) AS lookup_error FROM maps WHERE place_id IS NOT NULL GROUP BY 1",
    "requests": (
        f"SELECT 'r' || m.page_id AS run_id, m.page_id, m.maps_url, m.host_ok, m.place_id, coalesce(trim(l.website_url), '') AS website_url, {clean_domain('l.website_url')} AS domain, l.lookup_error,"
        " CASE WHEN m.page_id % 5 = 0 THEN 'call' END AS note, m.page_id % 4 = 0 AS tagged FROM maps m LEFT JOIN lookups l ON l.place_id = m.place_id"
    ),
    "req_targets": "SELECT run_id AS business_id, domain, website_url FROM requests WHERE domain <> ''",
}
CTES |= scan_ctes("req", "req_targets", SITE_PATHS)
CTES |= {
    "package_rows": (
        "SELECT r.*, l.errors, l.safe_errors, l.results_found, l.wall, b.signal, coalesce(b.confidence, 0) AS confidence, coalesce(b.evidence, '') AS evidence, coalesce(b.es, []) AS es, coalesce(b.eu, []) AS eu,"
        " CASE WHEN NOT r.host_ok THEN 'invalid_maps_url' WHEN r.place_id IS NULL THEN 'place_id_not_found' WHEN r.lookup_error IS NOT NULL THEN 'places_lookup_failed' WHEN r.website_url = '' THEN 'website_missing'"
        " WHEN coalesce(l.wall, false) AND NOT coalesce(l.results_found, false) THEN 'cookie_wall' ELSE 'ok' END AS outcome"
        " FROM requests r LEFT JOIN req_lists l ON l.business_id = r.run_id LEFT JOIN req_best b ON b.business_id = r.run_id"
    ),
    "package_live": (
        "SELECT *, outcome IN ('ok', 'cookie_wall') AS live, coalesce(signal = 'yes', false) AS yes, len(list_distinct(list_filter(eu, lambda x: "
        + f"lower({authority('x')}) = lower(domain) OR ends_with(lower({authority('x')}), '.' || lower(domain))"
        + "))) AS eligible FROM package_rows"
    ),
}


GENERIC_CONSENT, GENERIC_PAIR = ["oiç", "ción", "los "], ["thth", "ver"]
TARGET_PATH = path_of("target")
CTES["list_links"] = (
    "SELECT p.page_id, 1 AS i, coalesce(n.url, '/none') AS href, 'one' AS text, p.url AS base FROM site_pages p LEFT JOIN site_pages n ON n.page_id = p.page_id + 1"
    " UNION ALL SELECT p.page_id, 2, coalesce(n.url, '/none'), 'ing two', p.url FROM site_pages p LEFT JOIN site_pages n ON n.page_id = p.page_id + 3"
    " UNION ALL SELECT p.page_id, 3, coalesce(n.url, '/none') || '#x', 'again', p.url FROM site_pages p LEFT JOIN site_pages n ON n.page_id = p.page_id + 1"
    " UNION ALL SELECT page_id, i + 3, href, text, url FROM hrefs"
)
CTES["list_targets"] = (
    "SELECT page_id, min(i) AS i, target FROM (SELECT *, CASE WHEN starts_with(href, 'http') THEN href ELSE regexp_extract(base, '^([^:]+://[^/?#]*)', 1) || href END AS target FROM list_links"
    f" WHERE contains(lower(href), 'http') OR contains(lower(href), '/th') OR {any_word('text', V.text_hints)}) GROUP BY page_id, target"
)
CTES["list_skips"] = (
    f"SELECT *, {url_key('target')} AS url_key, CASE WHEN regexp_replace({TARGET_PATH}, '/+$', '') IN ('/the', '/and', '/que', '/de') THEN 'listing_url_skipped'"
    f" WHEN contains(lower({TARGET_PATH}), '/th') OR contains(lower({TARGET_PATH}), 'tion') OR contains(lower({query_of('target')}), 'utm_source=') OR contains(lower({query_of('target')}), 'page=') THEN 'non_job_url_skipped' END AS skipped FROM list_targets"
)
CTES["detail_text"] = (
    f"SELECT page_id, url, {url_key('url')} AS url_key, {title('html')} AS title, {body('html')} AS body, {node_text("regexp_extract(html, '(?is)<h1\\b[^>]*>(.*?)</h1\\s*>', 0)")} AS h1 FROM site_pages"
)
CTES["detail_facts"] = (
    "SELECT url_key, url AS job_url, h1 AS job_title, left(body, 300) AS snippet, "
    + detect("(h1 || ' ' || body)", TAG_RULES)
    + f" AS tags, len({found_words('t', GENERIC_CONSENT)}) >= 2 OR (contains(t, 'thth') AND contains(t, 'ver')) AS is_consent"
    " FROM (SELECT *, lower(title || ' ' || body) AS t, row_number() OVER (PARTITION BY url_key ORDER BY page_id) AS rn FROM detail_text) WHERE rn = 1"
)
CTES["opened"] = "SELECT l.page_id, l.target, f.* FROM list_skips l JOIN detail_facts f ON f.url_key = l.url_key WHERE l.skipped IS NULL"
CTES["signal_keys"] = f"SELECT DISTINCT {url_key('url')} AS url_key FROM site_pages_found WHERE has_signal"
CTES["first_links"] = (
    "SELECT s.business_id, CAST(row_number() OVER (PARTITION BY t.page_id ORDER BY min(t.i)) - 1 AS INT) AS ord, t.target AS link FROM targets t JOIN sites s ON s.ord = t.page_id"
    f" WHERE {any_word('lower(t.href)', V.url_hints)} OR {any_word('t.text', V.text_hints)} GROUP BY s.business_id, t.page_id, t.target"
)
CTES["suggested"] = (
    "SELECT business_id, 0 AS rk, 500 AS ord, 'https://boards.greenhouse.io/co' || ord AS u, 'ats' AS source, 'high' AS confidence, 'found greenhouse link' AS reason FROM sites WHERE ord % 3 = 0"
    " UNION ALL "
    + " UNION ALL ".join(
        f"SELECT business_id, 1, {i}, 'https://' || domain || {q(p)}, 'common_path', 'med', 'matched common path {p}' FROM sites WHERE {url_key('(chr(104) || chr(116) || chr(116) || chr(112) || chr(115) || chr(58) || chr(47) || chr(47) || domain || ' + q(p) + ')')} IN (SELECT url_key FROM signal_keys)"
        for i, p in enumerate(SITE_PATHS)
    )
    + " UNION ALL SELECT business_id, 2, ord, link, 'homepage_link', 'med', 'homepage link with job signals' FROM (SELECT * FROM first_links UNION ALL SELECT 'H-' || host, page_id + 1000, url FROM page_parts)"
    f" WHERE {url_key('link')} IN (SELECT url_key FROM signal_keys)"
)
NL = "chr(10)"


def bullet_lines(listing: str, fallback: str) -> str:
    return f"CASE WHEN len({listing}) > 0 THEN array_to_string(list_transform({listing}, lambda x: '- ' || x), {NL}) ELSE '- {fallback}' END"


def nonnull(*items: str) -> str:
    return "list_filter([" + ", ".join(items) + "], lambda x: x IS NOT NULL)"


CTES["req_wall_best"] = "SELECT business_id, arg_max(signals, score * 1000 - ord) AS signals FROM req_judged WHERE fetched AND is_wall GROUP BY 1"
CTES["dossier"] = (
    "SELECT p.*, CASE WHEN live THEN domain ELSE '' END AS dom, CASE WHEN live THEN website_url ELSE '' END AS web,"
    " CASE WHEN NOT live THEN 'uncertain' WHEN yes AND eligible >= 2 THEN 'yes' WHEN yes AND eligible = 1 THEN 'maybe' ELSE 'uncertain' END AS hs,"
    " CASE WHEN NOT live THEN 0e0 WHEN yes AND eligible = 1 THEN least(confidence, 0.5e0) WHEN yes AND eligible = 0 THEN least(confidence, 0.2e0) ELSE confidence END AS hc,"
    " CASE outcome WHEN 'ok' THEN 'ok' WHEN 'invalid_maps_url' THEN 'error' WHEN 'places_lookup_failed' THEN 'error' ELSE 'degraded' END AS st,"
    " CASE WHEN outcome IN ('ok', 'invalid_maps_url', 'places_lookup_failed') THEN 'none' ELSE outcome END AS reason,"
    f" CASE WHEN live THEN {nonnull("nullif(evidence, '')", "CASE WHEN yes AND eligible < 2 THEN 'insufficient_evidence_urls' END")} ELSE []::VARCHAR[] END AS why,"
    " CASE WHEN live THEN list_transform(es, lambda x, i: x || ' (' || coalesce(eu[i], eu[1]) || ')') ELSE []::VARCHAR[] END AS ev,"
    " CASE WHEN NOT live OR coalesce(l.skipped, '') = '' THEN []::VARCHAR[] ELSE list_transform(string_split(l.skipped, ';'), lambda x: 'Skipped: ' || x) END AS sk,"
    " CASE WHEN live AND coalesce(p.safe_errors, '') = '' THEN []::VARCHAR[] WHEN live THEN list_transform(string_split(p.safe_errors, '|'), lambda x: 'Error: ' || x) WHEN outcome = 'places_lookup_failed' THEN ['Error: places_lookup_failed:' || lookup_error] ELSE ['Error: ' || outcome] END AS er,"
    " CASE WHEN coalesce(p.wall, false) THEN ['Cookie wall detected' || CASE WHEN len(w.signals) > 0 THEN ' (signals: ' || array_to_string(w.signals, ', ') || ')' ELSE '' END || '.'] ELSE []::VARCHAR[] END AS wl,"
    " CASE WHEN outcome IN ('place_id_not_found', 'website_missing') THEN ['Next action: Paste official website URL to proceed.'] WHEN outcome = 'cookie_wall' THEN ['Next action: Cookie wall detected. Open site manually and retry.'] ELSE []::VARCHAR[] END AS nx,"
    f" {nonnull('note', "CASE WHEN tagged THEN 'Tags: a, b' END")} AS nt, CASE WHEN outcome IN ('invalid_maps_url', 'place_id_not_found') THEN 'unknown' ELSE 'places' END AS ws"
    " FROM package_live p LEFT JOIN req_lists l ON l.business_id = p.run_id LEFT JOIN req_wall_best w ON w.business_id = p.run_id"
)


def prev_ctes(used: str) -> list[str]:
    """The CTEs a statement needs, in order of definition depth."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"[a-z_0-9]+", re.sub(r"'(?:[^']|'')*'", "''", text)):
            if name in CTES and name not in order and name not in visiting:
                visiting.add(name)
                visit(CTES[name])
                order.append(name)

    visiting: set[str] = set()
    visit(used)
    return order


def sql(statement: str) -> str:
    needed = prev_ctes(statement)
    if not needed:
        return statement
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in needed) + "\n" + statement


SPEC_CHECKS = [
    ("housing_name", f"NOT {housing('name')}", None),
    ("hidden", "NOT hide_flag", None),
    ("excluded_reason", "coalesce(excluded_reason, '') = ''", None),
    (
        "city",
        " OR ".join(f"coalesce({fold(c)} IN ('mantsala', 'lahti', 'jyvaskyla') AND {c} IS NOT NULL, false)" for c in ("city", "_source_city", "domicile")),
        "'city:' || coalesce("
        + ", ".join(f"CASE WHEN {c} IS NOT NULL AND {fold(c)} IN ('mantsala', 'lahti', 'jyvaskyla') THEN {c} END" for c in ("city", "_source_city", "domicile"))
        + ")",
    ),
    ("min_score", "score >= 1", "'min_score'"),
    ("max_distance_km", "distance_km <= 60", "'max_distance_km'"),
    ("include_tags", "list_has_any(tags_effective, ['data', 'ai', 'junior'])", "'include_tags'"),
    ("exclude_tags", "NOT list_contains(tags_effective, 'salesforce')", None),
    ("search", " OR ".join(f"contains(lower(coalesce({c}, '')), 'customer#')" for c in ("name", "business_id", "website_url", "note")), None),
]
SPEC_ALL = " AND ".join(f"coalesce(({c}), false)" for _, c, _ in SPEC_CHECKS)


def preset_sql(name: str) -> str:
    p = rules.PRESETS[name]
    parts = [f"score >= {p['min_score']}", f"distance_km <= {p['max_distance_km']}"]
    if not p.get("include_housing"):
        parts.append(f"NOT {housing('name')}")
    if not p.get("include_hidden"):
        parts.append("NOT hide_flag")
    if not p.get("include_excluded"):
        parts.append("coalesce(excluded_reason, '') = ''")
    if p.get("statuses"):
        parts.append(f"status IN ({', '.join(q(s) for s in p['statuses'])})")
    if p.get("industries"):
        parts.append(f"industry_effective IN ({', '.join(q(s) for s in p['industries'])})")
    if p.get("only_recruiting"):
        parts.append("recruiting_active")
    return f"SELECT {q(name)} AS preset, count(*) FILTER ({' AND '.join(parts)}) AS n_rows FROM effective"


REG_ADDRESS = {
    f: f"coalesce(CASE WHEN trim(city0) = trim(_source_city) THEN {f}0 WHEN trim(city1) = trim(_source_city) THEN {f}1 END, {f}0)" for f in ("street", "post", "city")
}
NAME_RANK = "SELECT business_id, name, row_number() OVER (PARTITION BY business_id ORDER BY CASE WHEN coalesce(trim(e), '') = '' THEN 0 ELSE 1 END, CASE WHEN t = '1' THEN 0 ELSE 1 END, coalesce(r, '') DESC, pos) AS rn FROM (" + " UNION ALL ".join(
    f"SELECT business_id, {i} AS pos, name{i} AS name, type{i} AS t, reg{i} AS r, end{i} AS e FROM registry" for i in range(3)
) + ")"
CTES["official"] = f"SELECT business_id, name FROM ({NAME_RANK}) WHERE rn = 1"
CTES["normalized"] = (
    "SELECT r.ord, r.business_id, o.name, coalesce(nullif(trim(a_street), ''), '') AS street, coalesce(nullif(trim(a_post), ''), '') AS post_code,"
    " coalesce(nullif(trim(a_city), ''), nullif(trim(domicile), ''), nullif(trim(_source_city), ''), '') AS city, r.custkey FROM (SELECT *, "
    + ", ".join(f"{v} AS a_{k}" for k, v in REG_ADDRESS.items())
    + ", ord AS custkey FROM registry) r JOIN official o ON o.business_id = r.business_id"
)
CTES["normalized2"] = (
    "SELECT *, strip_accents(array_to_string(list_filter([nullif(street, ''), nullif(post_code, ''), nullif(city, '')], lambda x: x IS NOT NULL), ', ')) AS full_address FROM normalized"
)
CTES["address_cache"] = (
    "SELECT full_address, 60e0 + (k * 37 % 500) / 100e0 AS lat, 22e0 + (k * 53 % 750) / 100e0 AS lon FROM (SELECT full_address, min(ord) AS k FROM normalized2 GROUP BY 1) WHERE k % 2 = 0"
)
CTES["run_near"] = (
    f"SELECT n.business_id, s.station_name, {hav('s.lat', 's.lon', 'c.lat', 'c.lon')} AS km, row_number() OVER (PARTITION BY n.business_id ORDER BY {hav('s.lat', 's.lon', 'c.lat', 'c.lon')}, s.ord) AS rn"
    " FROM normalized2 n JOIN address_cache c ON c.full_address = n.full_address, stations s"
)
CTES["cache_rows"] = (
    "SELECT array_to_string(list_filter([note, city], lambda x: x IS NOT NULL), ', ') AS address, CAST(ord AS DOUBLE) AS lat, CAST(ord * 2 AS DOUBLE) AS lon, lpad(CAST(ord AS VARCHAR), 9, '0') AS ts FROM companies WHERE ord % 3 <> 1"
)
CTES["cache_one"] = "SELECT address, arg_max(lat, ts) AS lat, arg_max(lon, ts) AS lon FROM cache_rows GROUP BY 1"
ADDR = "array_to_string(list_filter([note, city], lambda x: x IS NOT NULL), ', ')"
SCORE_PARTS = [
    ("distance_km <= 15", "loc_ok", 3),
    ("{g}pass AND starts_with({g}reason, 'whitelist:')", "industry_ok", 3),
    ("{g}hard", "industry_blacklist", -5),
    ("excluded IS NOT NULL", "excluded", -10),
    ("active", "recruiting_active", 2),
    ("fresh > 0", "new_jobs", 1),
    *[(f"n_{t} > 0", f"tag_{t}", 1) for t in rules.ACTIVITY_TAGS],
]


def score_sql(source: str, allow, deny, line: str) -> str:
    inner = (
        f"SELECT c.*, {gate(line, allow, deny, 'pass')} AS g_pass, {gate(line, allow, deny, 'reason')} AS g_reason, {gate(line, allow, deny, 'hard')} AS g_hard,"
        " coalesce(a.recruiting_active, false) AS active, coalesce(a.job_count_new_since_last, 0) AS fresh, "
        + ", ".join(f"coalesce(a.tag_count_{t}, 0) AS n_{t}" for t in rules.ACTIVITY_TAGS)
        + f" FROM ({source}) c LEFT JOIN activity a ON a.business_id = c.business_id"
    )
    conds = [(c.replace("{g}", "g_"), label, w) for c, label, w in SCORE_PARTS]
    total = " + ".join(f"(CASE WHEN {c} THEN {w} ELSE 0 END)" for c, _, w in conds)
    reasons = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{label}' END" for c, label, _ in conds) + "], lambda x: x IS NOT NULL), ';')"
    return f"SELECT *, CAST({total} AS BIGINT) AS total, {reasons} AS reasons FROM ({inner})"


CTES["watched"] = (
    "SELECT j.*, s.score, s.distance_km, s.nearest_station, s.name AS lookup_name, coalesce("
    + usable("j.company_name")
    + ", "
    + usable("s.name")
    + ", j.company_domain, j.company_business_id) AS company_label FROM new_jobs j LEFT JOIN shortlist s ON s.business_id = j.company_business_id"
    " WHERE list_has_any(j.tags, ['data', 'it_support', 'oppisopimus']) AND NOT contains(lower(j.job_title || ' ' || j.description_snippet), 'order o') AND coalesce(s.score >= 2, true)"
)
UPSERTED = (
    "SELECT coalesce(o.business_id, e.business_id) AS business_id, "
    + ", ".join(f"CASE WHEN e.business_id IS NOT NULL THEN e.{f} ELSE o.{f} END AS {f}" for f in ("status", "hide_flag", "note", "industry_override"))
    + ", "
    + ", ".join(
        f"CASE WHEN e.business_id IS NOT NULL THEN array_to_string({in_order_distinct(tag_parts(f'e.{f}'))}, ';') ELSE o.{f} END AS {f}" for f in ("tags_add", "tags_remove")
    )
    + ", o.updated_at, CASE WHEN e.business_id IS NOT NULL THEN 'me' ELSE o.updated_by END AS updated_by, CASE WHEN e.business_id IS NOT NULL THEN 'm2' ELSE o.source_master END AS source_master"
    " FROM edits o FULL JOIN new_edits_all e ON e.business_id = o.business_id"
)
CTES["upserted"] = UPSERTED
FIELDS = ["status", "hide_flag", "note", "industry_override", "tags_add", "tags_remove"]
CTES["changed"] = (
    "SELECT b.business_id, list_filter(["
    + ", ".join(f"CASE WHEN b.{f} IS DISTINCT FROM a.{f} THEN '{f}' END" for f in FIELDS)
    + "], lambda x: x IS NOT NULL) AS fields FROM edits b JOIN upserted a ON a.business_id = b.business_id"
)


def top3(source: str, key: str, item: str, text: str, sep: str) -> str:
    return (
        f"SELECT {key}, string_agg({text}, '{sep}' ORDER BY n DESC, {item}) AS t FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, {item}) AS rn FROM ({source})) WHERE rn <= 3 GROUP BY 1"
    )


PLACE_PARTS = f"list_filter(list_transform(string_split(coalesce(formatted_address, ''), ','), lambda x: {strip('x')}), lambda x: x <> '')"
CTES["place_split"] = f"SELECT *, {PLACE_PARTS} AS parts FROM places"
CTES["place_city"] = (
    "SELECT *, CASE WHEN len(parts) >= 2 AND lower(parts[-1]) IN ('finland', 'suomi') THEN parts[-2] ELSE parts[-1] END AS part FROM place_split"
)
CTES["place_words"] = "SELECT *, regexp_split_to_array(part, '\\s+') AS words FROM place_city"
CTES["place_parsed"] = (
    "SELECT *, coalesce(parts[1], '') AS street, CASE WHEN regexp_matches(words[1], '^[0-9]+$') THEN words[1] ELSE '' END AS post_code,"
    " coalesce(CASE WHEN regexp_matches(words[1], '^[0-9]+$') AND len(words) > 1 THEN array_to_string(words[2:], ' ') ELSE part END, '') AS city FROM place_words"
)
DOC_RULES = {"that": ["that", "thth"], "sch": ["sch", "nicht"], "que": [" que "], "data": ["data"]}
FIRST_PARTY_LINK = f"CASE WHEN page_id % 5 = 0 THEN 'https://c' || page_id || '.lever.co/x' ELSE url END"
PARTY_DOMAIN = f"CASE page_id % 3 WHEN 0 THEN {authority('url')} WHEN 1 THEN regexp_replace({authority('url')}, '^[^.]*\\.', '') ELSE 'thre.example.com' END"

STATEMENTS: dict[str, str] = {
    "pick_first": f"SELECT business_id, coalesce({filled('website_url')}, {filled('_source_city')}, {filled('note')}, {filled('name')}, '') AS value FROM companies",
    "clean_address": f"SELECT business_id, strip_accents(array_to_string(list_filter([{filled('street1')}, {filled('post1')}, {filled('city0')}], lambda x: x IS NOT NULL), ', ')) AS address FROM registry",
    "address_pick": f"SELECT business_id, {REG_ADDRESS['street']} AS street, {REG_ADDRESS['post']} AS post_code, {REG_ADDRESS['city']} AS city FROM registry",
    "official_name": "SELECT business_id, name FROM official",
    "normalize_registry": "SELECT business_id, name, street, post_code, city, full_address, 'other' AS industry FROM normalized2",
    "parse_address": "SELECT ord, street, post_code, city FROM place_parsed",
    "clean_domain": f"SELECT business_id, {clean_domain('website_url')} AS domain FROM companies",
    "domain_template": f"SELECT business_id, coalesce(nullif({clean_domain('domain')}, ''), nullif({clean_domain('website_url')}, ''), '') AS domain FROM companies",
    "url_party": f"SELECT page_id, h = lower(d) OR ends_with(h, '.' || lower(d)) AS first_party, regexp_matches(h, '(^|\\.)({'|'.join(a.replace('.', chr(92) + '.') for a in rules.ATS_HOSTS)})$') AS ats_host FROM (SELECT page_id, {PARTY_DOMAIN} AS d, lower({authority(f'({FIRST_PARTY_LINK})')}) AS h FROM site_pages)",
    "place_id_extract": "SELECT page_id, CASE WHEN host_ok THEN place_id END AS place_id FROM maps",
    "fold_city": f"SELECT business_id, {fold('city')} AS folded, strip_accents(city) AS ascii FROM companies",
    "normalize_tags": f"SELECT business_id, array_to_string({in_order_distinct(tag_parts('tags'))}, '|') AS ordered, array_to_string({sorted_tags('tags')}, '|') AS sorted FROM companies",
    "detect_tags": f"SELECT doc_id, {joined(detect('text', DOC_RULES))} AS tags FROM documents",
    "haversine": f"SELECT business_id, round({hav('lat', 'lon', '60.1699e0', '24.9384e0')}, 6) AS km FROM companies",
    "job_fingerprint": "SELECT ord, fp AS fingerprint FROM jobs",
    "snippets": f"SELECT doc_id, {joined(snippets('text', V.evidence, 4))} AS snippets FROM documents",
    "posted_ts": f"SELECT ord, strftime({POSTED}, '%Y-%m-%d %H:%M:%S') AS posted FROM jobs_raw",
    "json_repair": "SELECT answer_id, json_extract_string(j, '$.hiring_signal') AS hiring_signal, CAST(json_extract(j, '$.confidence') AS DOUBLE) AS confidence, json_extract_string(j, '$.evidence_snippets[0]') AS first_snippet FROM (SELECT answer_id, try_cast(nullif(regexp_extract(answer, '(?s)\\{.*\\}', 0), '') AS JSON) AS j FROM model_answers)",
    "evidence_pairs": "SELECT answer_id, array_to_string(list_transform(raw_s, lambda x, i: x || ' @ ' || coalesce(raw_u[i], raw_u[1], '')), '|') AS evidence FROM gated",
    "coerce_values": (
        "SELECT business_id, CASE WHEN lower(trim(w)) IN ('true', '1', 'yes', 'y', 't') THEN true WHEN lower(trim(w)) IN ('false', '0', 'no', 'n', 'f') THEN false END AS flag, try_cast(trim(n) AS DOUBLE) AS number,"
        " CASE WHEN l = '[broken' THEN NULL WHEN l LIKE '[%' THEN 'a|b' WHEN trim(coalesce(l, '')) = '' THEN '' ELSE array_to_string(list_filter(list_transform(string_split(trim(l), ';'), lambda x: trim(x)), lambda x: x <> ''), '|') END AS items FROM ("
        "SELECT business_id, CASE ord % 5 WHEN 0 THEN ' Yes ' WHEN 1 THEN 'f' WHEN 2 THEN 'maybe' ELSE CAST(recruiting_active AS VARCHAR) END AS w, CASE ord % 3 WHEN 0 THEN '12.5 ' WHEN 1 THEN 'x' ELSE CAST(score AS VARCHAR) END AS n, CASE ord % 4 WHEN 0 THEN '[\"a\",\"b\"]' WHEN 1 THEN '[broken' ELSE tags END AS l FROM companies)"
    ),
    "nearest_station": "SELECT business_id, nearest_station, round(distance_km, 6) AS distance_km FROM shortlist",
    "nearest_station_cells": "SELECT business_id, nearest_station, round(distance_km, 6) AS distance_km FROM shortlist",
    "radius_join": "SELECT business_id, station_name, round(km, 6) AS distance_km FROM near WHERE km <= 30",
    "nearby_report": "SELECT business_id, name, nearest_station, round(distance_km, 6) AS distance_km FROM shortlist WHERE distance_km <= 25",
    "industry_classify": "SELECT business_id, industry FROM companies",
    "industry_classify_table": "SELECT business_id, industry FROM companies",
    "places_master": f"SELECT business_id, name, full_address, street, post_code, city, nearest_station, round(distance_km, 6) AS distance_km, website_url, 'neutral' AS status, 'other' AS industry, 'google_places_new' AS source FROM (SELECT p.place_id AS business_id, p.name, p.formatted_address AS full_address, p.street, p.post_code, p.city, s.station_name AS nearest_station, {hav('s.lat', 's.lon', 'p.lat', 'p.lon')} AS distance_km, p.website AS website_url, row_number() OVER (PARTITION BY p.place_id ORDER BY {hav('s.lat', 's.lon', 'p.lat', 'p.lon')} NULLS LAST, p.ord) AS rn FROM place_parsed p JOIN stations s ON s.ord = p.station_key WHERE p.place_id <> '') WHERE rn = 1",
    "housing_filter": f"SELECT business_id, name FROM companies WHERE {housing('name')}",
    "exclude_reason": f"SELECT business_id, {excluded('company_form', 'name')} AS reason FROM companies",
    "industry_gate": "SELECT business_id, " + ", ".join(f"{gate('main_business_line', ['62', '1'], ['47', '5.'], k)} AS {a}" for k, a in (("pass", "passes"), ("reason", "reason"), ("hard", "hard"))) + " FROM companies",
    "dedup_companies": (
        "SELECT business_id, ord, name, round(lat, 6) AS lat FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY CASE WHEN lat IS NULL OR lon IS NULL THEN 1 ELSE 0 END, ord) AS rn FROM ("
        "SELECT business_id, ord, name, CASE WHEN ord % 2 = 1 THEN lat END AS lat, lon FROM companies UNION ALL SELECT business_id, ord + 10000000000, 'copy ' || name, lat + 0.5e0, lon FROM companies WHERE ord % 5 = 0)) WHERE rn = 1"
        " UNION ALL SELECT ' ', ord + 20000000000, name, round(lat, 6) FROM companies WHERE ord % 7 = 0"
    ),
    "union_dedup": (
        "SELECT place_id, ord, station_key FROM (SELECT nullif(place_id, '') AS place_id, ord, station_key, row_number() OVER (PARTITION BY place_id ORDER BY CASE station_key % 3 WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 END, ord) AS rn FROM places) WHERE rn = 1 OR place_id IS NULL"
    ),
    "domain_ladder": f"SELECT business_id, coalesce({usable('domain')}, CASE WHEN ord % 4 = 0 THEN 'alt' || ord || '.example' WHEN ord % 2 = 0 THEN 'map' || ord || '.example' END, CASE WHEN ord % 3 = 0 THEN 'sug' || ord || '.example' END, '') AS domain FROM companies",
    "domain_fill": f"SELECT business_id, coalesce({usable('domain')}, {clean_domain('website_url')}) AS domain FROM companies",
    "missing_website": f"SELECT business_id, website_url FROM companies WHERE {usable('website_url')} IS NULL",
    "geocode_cache_hit": f"SELECT c.business_id, round(h.lat, 6) AS lat, round(h.lon, 6) AS lon, CASE WHEN h.address IS NOT NULL THEN 'cache' END AS provider FROM (SELECT *, {ADDR} AS address FROM companies) c LEFT JOIN cache_one h ON h.address = c.address",
    "geocode_cache_miss": f"SELECT DISTINCT address FROM (SELECT {ADDR} AS address FROM companies) c WHERE trim(address) <> '' AND address NOT IN (SELECT address FROM cache_rows)",
    "geocode_cache_merge": f"SELECT address, round(arg_max(lat, ts), 6) AS lat, round(arg_max(lon, ts), 6) AS lon, max(ts) AS ts FROM (SELECT * FROM cache_rows UNION ALL SELECT {ADDR}, lat, lon, lpad(CAST(ord + 7 AS VARCHAR), 9, '0') FROM companies WHERE ord % 4 = 1 AND lat IS NOT NULL) GROUP BY 1",
    "employee_join": "SELECT business_id, CASE WHEN ord % 8 = 0 THEN CAST((ord + 7) % 50 AS INT) WHEN ord % 4 = 0 THEN CAST(ord % 100 AS INT) END AS employee_count, CASE WHEN ord % 8 = 0 THEN '0-49' WHEN ord % 4 = 0 THEN '1-99' END AS employee_band FROM companies",
    "company_score": "SELECT business_id, total AS score, reasons AS score_reasons FROM ("
    + score_sql(f"SELECT business_id, distance_km, main_business_line, {excluded('company_form', 'name')} AS excluded FROM shortlist", ["62", "1"], ["47", "5."], "main_business_line")
    + ")",
    "effective_view": f"SELECT business_id, status, hide_flag, note, industry_effective, {joined('tags_effective')} AS tags FROM effective",
    "effective_filter": f"SELECT business_id, name, nearest_station FROM effective WHERE {SPEC_ALL}",
    "explain_filter": f"SELECT business_id, {SPEC_ALL} AS passes, {joined('list_filter([' + ', '.join(f'CASE WHEN {c} THEN {r} END' for _, c, r in SPEC_CHECKS if r) + '], lambda x: x IS NOT NULL)')} AS reasons, "
    + joined("list_filter([" + ", ".join(f"CASE WHEN NOT coalesce(({c}), false) THEN '{n}' END" for n, c, _ in SPEC_CHECKS) + "], lambda x: x IS NOT NULL)")
    + " AS fails FROM effective",
    "effective_view_meta": f"SELECT (SELECT count(*) FROM companies) AS rows_master, (SELECT count(*) FROM edits) AS rows_curation, count(*) FILTER ({SPEC_ALL}) AS rows_filtered, '20240101' AS date_master, '20240102' AS date_diff, true AS mismatch FROM effective",
    "preset_counts": " UNION ALL ".join(preset_sql(n) for n in rules.PRESETS),
    "map_filter": f"SELECT business_id FROM shortlist WHERE lat IS NOT NULL AND lon IS NOT NULL AND industry IN ('it', 'manufacturing') AND regexp_matches(main_business_line, '^[612]') AND recruiting_active AND score >= 3 AND distance_km <= 40 AND NOT {housing('name')}",
    "scan_targets": "SELECT business_id, domain FROM shortlist WHERE lower(nearest_station) = 'nation_3' AND distance_km <= 40 AND trim(domain) <> ''",
    "retention_split": "SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-16') AS kept, count(*) FILTER (ts < TIMESTAMP '2024-01-16') AS purged FROM events GROUP BY 1",
    "filter_values": "SELECT DISTINCT 'city' AS kind, trim(v) AS value FROM (SELECT city AS v FROM effective UNION ALL SELECT _source_city FROM effective UNION ALL SELECT domicile FROM effective) WHERE trim(v) <> '' UNION ALL SELECT DISTINCT 'industry', industry_effective FROM effective",
    "prev_next": "SELECT business_id, lag(business_id) OVER o AS prev_id, lead(business_id) OVER o AS next_id FROM shortlist WINDOW o AS (ORDER BY score DESC NULLS LAST, name, business_id)",
    "company_jobs_semi": "SELECT ord, company_business_id FROM jobs_raw WHERE company_business_id IN (SELECT business_id FROM companies WHERE recruiting_active)",
    "key_violations": "SELECT key, CASE WHEN key = '' THEN 'blank' ELSE 'duplicate' END AS problem, count(*) AS n_rows FROM (SELECT CASE WHEN ord % 97 = 0 THEN '' ELSE company_business_id END AS key FROM jobs_raw) GROUP BY 1 HAVING key = '' OR count(*) > 1",
    "overlay_upsert": "SELECT * FROM upserted",
    "merge_edits": (
        "SELECT coalesce(a.business_id, b.business_id) AS business_id, coalesce(b.status, a.status) AS status, a.hide_flag, coalesce(b.note, a.note) AS note, a.industry_override, coalesce(b.tags_add, a.tags_add) AS tags_add, a.tags_remove,"
        " CASE WHEN a.business_id IS NOT NULL THEN 'hide_flag|industry_override|note|status|tags_add|tags_remove' ELSE 'note|status|tags_add' END AS present FROM new_edits a FULL JOIN new_edits_b b ON a.business_id = b.business_id"
    ),
    "edit_diff": "SELECT " + ", ".join(f"count(*) FILTER (list_contains(fields, '{f}')) AS {f}" for f in FIELDS) + ", count(*) FILTER (len(fields) > 0) AS changed_rows_count FROM changed",
    "edit_diff_rows": "SELECT business_id, array_to_string(fields, '|') AS changed_fields FROM changed WHERE len(fields) > 0",
    "dedup_jobs": "SELECT ord, company_business_id, job_url, fp AS job_fingerprint FROM distinct_jobs",
    "jobs_diff": "SELECT ord, company_business_id, job_title, job_url FROM new_jobs",
    "jobs_diff_flagged": "SELECT ord, job_url, is_new FROM flagged",
    "company_activity": "SELECT * FROM activity",
    "jobs_with_company": "SELECT j.ord, j.company_business_id, v.name, v.nearest_station, round(v.distance_km, 6) AS distance_km, v.score, v.industry_effective, v.status FROM new_jobs j LEFT JOIN effective v ON v.business_id = j.company_business_id",
    "jobs_per_company": "SELECT company_business_id AS business_id, count(*) AS n_jobs FROM jobs_raw GROUP BY 1",
    "watch_list": "SELECT ord, company_business_id, company_label, job_title, true AS tag_hit, score, round(distance_km, 6) AS distance_km, nearest_station FROM watched WHERE coalesce(distance_km <= 70, true) ORDER BY coalesce(score, -1e9) DESC, coalesce(distance_km, 1e9), ord LIMIT 200",
    "watch_company_counts": "SELECT company_business_id, count(*) AS n_jobs, coalesce(max(lookup_name), '') AS name FROM watched WHERE coalesce(distance_km <= 70, true) GROUP BY 1",
    "watch_lines": (
        "SELECT '- ' || company_label || ' (' || company_business_id || '): ' || job_title || chr(10) || '  tags: ' || array_to_string(tags, ', ')"
        " || coalesce(chr(10) || '  location: ' || location_text, '')"
        " || CASE WHEN score IS NULL AND nearest_station IS NULL THEN '' ELSE chr(10) || '  ' || array_to_string(list_filter(['score=' || CAST(score AS VARCHAR), 'station=' || nearest_station], lambda x: x IS NOT NULL), ', ') END"
        " || chr(10) || '  link: ' || job_url AS block FROM watched"
    ),
    "station_summary": (
        "SELECT nearest_station AS station, count(*) AS companies_total, count(*) FILTER (recruiting_active) AS recruiting_active_companies, CAST(coalesce(sum(n), 0) AS BIGINT) AS new_jobs_total, round(median(score), 6) AS median_score, round(median(distance_km), 6) AS median_distance_km"
        " FROM shortlist s LEFT JOIN new_counts c ON c.business_id = s.business_id WHERE nearest_station IS NOT NULL GROUP BY 1"
    ),
    "industry_summary": (
        "SELECT a.*, coalesce(t.t, '') AS top_stations FROM (SELECT industry, count(*) AS companies_total, count(*) FILTER (recruiting_active) AS recruiting_active, CAST(coalesce(sum(n), 0) AS BIGINT) AS new_jobs_total, round(median(distance_km), 6) AS median_distance_km"
        " FROM shortlist s LEFT JOIN new_counts c ON c.business_id = s.business_id GROUP BY 1) a LEFT JOIN ("
        + top3("SELECT industry, nearest_station, count(*) AS n FROM shortlist WHERE nearest_station IS NOT NULL GROUP BY 1, 2", "industry", "nearest_station", "nearest_station || ' (' || n || ')'", ", ")
        + ") t ON t.industry = a.industry"
    ),
    "tag_summary": "SELECT tag, count(*) AS new_jobs, count(DISTINCT j.company_business_id) AS unique_companies, round(median(distance_km), 6) AS median_distance_km FROM (SELECT unnest(tags) AS tag, company_business_id FROM new_jobs) j LEFT JOIN shortlist s ON s.business_id = j.company_business_id GROUP BY 1",
    "kpi": (
        "SELECT (SELECT count(*) FROM new_jobs) AS new_jobs_total, (SELECT count(*) FROM companies WHERE recruiting_active) AS companies_recruiting_active, count(*) AS domains_crawled, count(*) FILTER (jobs_found > 0) AS domains_with_jobs,"
        " (SELECT string_agg(status || ':' || n, ';' ORDER BY n DESC, status) FROM (SELECT status, count(*) AS n FROM stats WHERE status <> 'ok' GROUP BY 1 ORDER BY n DESC, status LIMIT 3)) AS top_skip_reasons FROM stats"
    ),
    "top_companies": (
        "SELECT s.business_id, s.name, s.score, round(s.distance_km, 6) AS distance_km, s.nearest_station AS station, s.recruiting_active, coalesce(c.n, 0) AS new_jobs_count, coalesce(t.t, '') AS top_tags FROM shortlist s LEFT JOIN new_counts c ON c.business_id = s.business_id LEFT JOIN ("
        + top3("SELECT company_business_id AS business_id, tag, count(*) AS n FROM (SELECT company_business_id, unnest(tags) AS tag FROM jobs) GROUP BY 1, 2", "business_id", "tag", "tag || '(' || n || ')'", ";")
        + ") t ON t.business_id = s.business_id ORDER BY coalesce(c.n, 0) DESC, s.score DESC NULLS LAST, s.business_id LIMIT 50"
    ),
    "quality_alerts": "SELECT count(*) FILTER (website_url IS NULL) AS missing_website, count(*) FILTER (lat IS NULL OR lon IS NULL) AS missing_latlon, count(*) FILTER (industry_effective IS NULL) AS missing_industry FROM effective",
    "jobs_by_company": f"SELECT j.company_business_id AS business_id, coalesce(arg_min(j.company_name, j.ord) FILTER (trim(j.company_name) <> ''), max(s.name), '') AS name, count(*) AS job_count, max(s.score) AS score FROM new_jobs j LEFT JOIN shortlist s ON s.business_id = j.company_business_id GROUP BY 1",
    "jobs_by_tag": "SELECT tag, count(*) AS new_jobs FROM (SELECT unnest(tags) AS tag FROM new_jobs) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
    "map_bounds": "SELECT round(median(lat), 6) AS median_lat, round(median(lon), 6) AS median_lon, round(avg(lat), 6) AS mean_lat, round(avg(lon), 6) AS mean_lon, round(min(lat), 6) AS min_lat, round(max(lat), 6) AS max_lat, round(min(lon), 6) AS min_lon, round(max(lon), 6) AS max_lon, count(*) AS n_points FROM companies WHERE lat IS NOT NULL AND lon IS NOT NULL",
    "map_layer": (
        "SELECT v.business_id, CASE WHEN job_count_new_since_last > 0 THEN 'red' WHEN recruiting_active THEN 'green' ELSE 'blue' END AS color,"
        " round(3 + 7 * ln(1 + job_count_total) / ln(1 + (SELECT max(job_count_total) FROM companies)), 6) AS radius,"
        " CASE WHEN status = 'shortlist' THEN '0,150,255,180' WHEN status = 'excluded' OR hide_flag THEN '160,160,160,120' WHEN recruiting_active THEN '0,200,0,180' ELSE '255,140,0,160' END AS status_rgba,"
        " 'all' || CASE WHEN recruiting_active THEN ',recruiting' ELSE '' END || CASE WHEN job_count_new_since_last > 0 THEN ',new_jobs' ELSE '' END AS layers,"
        " v.name || ' (' || v.business_id || ')' || chr(10) || 'Main business line: ' || main_business_line"
        " || CASE WHEN trim(coalesce(note, '')) = '' THEN '' WHEN length(trim(note)) > 120 THEN chr(10) || 'Note: ' || substr(trim(note), 1, 117) || '...' ELSE chr(10) || 'Note: ' || trim(note) END"
        " || CASE WHEN p.n IS NULL THEN chr(10) || 'New jobs: 0' ELSE chr(10) || 'New jobs (' || p.n || '):' || chr(10) || p.t || CASE WHEN p.n > 5 THEN chr(10) || '... +' || (p.n - 5) || ' more' ELSE '' END END AS popup,"
        " v.name || ' (status: ' || coalesce(status, '') || ', new: ' || job_count_new_since_last || ')' AS tooltip"
        " FROM effective v LEFT JOIN (SELECT company_business_id, max(n) AS n, string_agg('- ' || job_title || CASE WHEN len(tags) > 0 THEN ' [' || array_to_string(tags, ', ') || ']' ELSE '' END, chr(10) ORDER BY ord) FILTER (rn <= 5) AS t FROM (SELECT *, count(*) OVER (PARTITION BY company_business_id) AS n, row_number() OVER (PARTITION BY company_business_id ORDER BY ord) AS rn FROM new_jobs) GROUP BY 1) p ON p.company_business_id = v.business_id WHERE lat IS NOT NULL AND lon IS NOT NULL"
    ),
    "classifier_metrics": (
        "SELECT count(*) AS total, round(avg(CASE WHEN p = l THEN 1e0 ELSE 0 END), 6) AS accuracy, round(count(*) FILTER (p = 'yes' AND l = 'yes') / count(*) FILTER (p = 'yes'), 6) AS precision, round(count(*) FILTER (p = 'yes' AND l = 'yes') / count(*) FILTER (l = 'yes'), 6) AS recall, round(avg(CASE WHEN p = 'unclear' THEN 1e0 ELSE 0 END), 6) AS uncertain_rate"
        " FROM (SELECT CASE WHEN contains(lower(text), 'that') THEN 'yes' WHEN contains(lower(text), 'sch') THEN 'no' ELSE 'unclear' END AS p, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS l FROM documents JOIN labels USING (doc_id))"
    ),
    "geojson_features": "SELECT business_id, 'Feature' AS type, 'Point' AS geometry, round(lon, 6) AS x, round(lat, 6) AS y, name, job_count_total FROM companies WHERE lat IS NOT NULL AND lon IS NOT NULL",
    "latest_snapshot": "SELECT o_orderkey, o_orderpriority, strftime(o_orderdate, '%Y%m%d') AS run_date FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)",
    "crawl_stats": "SELECT * FROM stats",
    "crawl_status": "SELECT status, count(*) AS n_domains FROM stats GROUP BY 1",
    "crawl_coverage": (
        "SELECT count(*) AS domains_total, count(*) FILTER (jobs_found > 0) AS domains_with_jobs, (SELECT string_agg(status || '=' || n, ', ' ORDER BY n DESC, status) FROM (SELECT status, count(*) AS n FROM stats GROUP BY 1)) AS status_breakdown,"
        " (SELECT string_agg(status || ': ' || n, ', ' ORDER BY n DESC, status) FROM (SELECT status, count(*) AS n FROM stats WHERE status <> 'ok' GROUP BY 1 ORDER BY n DESC, status LIMIT 3)) AS top_skip_reasons,"
        " (SELECT string_agg(split_part(e, ':', 1) || ' (' || n || ')', ', ' ORDER BY n DESC, e) FROM (SELECT e, count(*) AS n FROM (SELECT unnest(string_split(errors_top, ';')) AS e FROM stats) GROUP BY 1 ORDER BY n DESC, e LIMIT 3)) AS top_errors FROM stats"
    ),
    "fetch_outcome": "SELECT seq, coalesce(status_code = 429 OR status_code BETWEEN 500 AND 599, false) AS retryable, CASE WHEN status_code IS NULL THEN coalesce(error, 'max_retries_exceeded') WHEN status_code >= 400 THEN 'http_' || status_code WHEN n_bytes > 2000000 THEN 'response_too_large' ELSE 'ok' END AS outcome, rtrim(final_url, '/') <> rtrim(url, '/') AS redirected FROM fetch_log",
    "domain_validation": (
        "SELECT business_id, name, domain, status, CASE WHEN status IN ('ok', 'consent_gate') AND ord % 5 = 0 THEN 'https://' || domain || '/start' ELSE '' END AS redirected_to, CASE WHEN status = 'fetch_failed' THEN 'dns' ELSE '' END AS reason FROM ("
        "SELECT s.business_id, s.name, s.ord, CASE WHEN s.ord % 9 = 0 THEN '' ELSE s.domain END AS domain, CASE WHEN s.ord % 9 = 0 THEN 'no_domain' WHEN s.ord % 4 = 1 THEN 'http_404' WHEN s.ord % 11 = 2 THEN 'fetch_failed' WHEN s.ord % 3 = 0 OR regexp_matches(lower(p.html), 'cookie|consent|eväste|evaste|hyväksy') THEN 'consent_gate' ELSE 'ok' END AS status FROM sites s JOIN site_pages p ON p.page_id = s.ord)"
    ),
    "page_budget": "SELECT host AS domain, page_id FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS rn FROM page_parts) WHERE rn <= 3",
    "site_candidates": "SELECT business_id, CAST(ord AS INT) AS ord, url, page_id FROM site_held",
    "access_gate": (
        "SELECT page_id, r = '' AS allowed, r AS skip_reason FROM (SELECT c.page_id, CASE WHEN c.host = 'ththin.example.com' THEN '' WHEN s.state = 'unreachable' THEN 'robots_unavailable' WHEN s.state = 'disallow_all' THEN 'robots_disallow_all'"
        " WHEN (SELECT arg_min(a.allow, a.ord) FROM access a WHERE a.host = c.host AND starts_with((CASE WHEN c.path = '' THEN '/' ELSE c.path END) || CASE WHEN c.qs <> '' THEN '?' || c.qs ELSE '' END, a.prefix)) = false THEN 'robots_disallow_url' ELSE '' END AS r FROM page_parts c LEFT JOIN states s ON s.host = c.host)"
    ),
    "page_text": f"SELECT page_id, {title('html')} AS title, {visible('html')} AS text FROM site_pages",
    "page_links": (
        "SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(i)) - 1 AS INT) AS ord, target FROM targets"
        f" WHERE {any_word('lower(href)', V.url_hints)} OR {any_word('text', V.text_hints)} GROUP BY page_id, target"
    ),
    "resolve_url": (
        "SELECT page_id, CASE page_id % 10 WHEN 0 THEN root || '/a/c' || page_id WHEN 1 THEN root || regexp_replace(regexp_replace(path, '[^/]*$', ''), '[^/]*/$', '') || 'up' || page_id WHEN 2 THEN split_part(url, ':', 1) || '://cdn.example/x' || page_id"
        " WHEN 3 THEN root || path || '?q=' || page_id WHEN 4 THEN regexp_replace(url, '#.*$', '') || '#part' WHEN 5 THEN 'mailto:a@b' || page_id WHEN 6 THEN 'HTTPS://Other.example/' || page_id WHEN 7 THEN root || regexp_replace(path, '[^/]*$', '') || 'leaf' || page_id || '?a=../b#c'"
        " WHEN 8 THEN url ELSE root || '/' END AS target FROM (SELECT *, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) AS root FROM page_parts)"
    ),
    "url_class": (
        "SELECT page_id, ord, regexp_replace(path, '/+$', '') IN ('/the', '/and', '/que', '/de') AS is_listing, contains(lower(path), '/th') OR contains(lower(path), 'tion') OR (ord % 4 = 0) AS is_non_job FROM ("
        "SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(i)) - 1 AS INT) AS ord, "
        + path_of("target")
        + " AS path FROM targets GROUP BY page_id, target)"
    ),
    "consent_pages": f"SELECT page_id, len({found_words('t', V.consent_words)}) >= 2 OR ({' AND '.join(f'contains(t, {q(w)})' for w in V.consent_pair)}) AS is_consent FROM (SELECT page_id, lower(title || ' ' || low_body) AS t FROM site_pages_feat)",
    "cookie_wall": f"SELECT page_id, is_wall, CAST(hits AS INT) AS wall_hits, round(score, 6) AS wall_score, {joined('matches')} AS matches, {joined('signals')} AS signals FROM site_pages_walls",
    "ats_detect": (
        f"SELECT page_id, kind, CASE kind WHEN 'lever' THEN coalesce({slug('lever' + chr(92) + '.co/([^/]*)')}, CASE WHEN contains(html, 'hire.lever.co') THEN 'hire' END) WHEN 'greenhouse' THEN {slug('greenhouse[^/]*/([^/]*)')}"
        f" WHEN 'recruitee' THEN {slug('//([^/.]*)[^/]*' + chr(92) + '.recruitee' + chr(92) + '.com')} WHEN 'teamtailor' THEN {slug('//([^/.]*)[^/]*' + chr(92) + '.teamtailor' + chr(92) + '.com')} END AS slug FROM (SELECT *, {ATS_KIND} AS kind FROM ats_pages)"
    ),
    "sitemap_urls": "SELECT 's' || page_id AS domain, 0 AS ord, 'https://s.example/job/' || page_id || '?a=1&b=2' AS url FROM site_pages UNION ALL SELECT 's' || page_id, 1, url FROM site_pages WHERE contains(lower(url), 'job') OR contains(lower(url), '/en/')",
    "job_signal": f"SELECT page_id, contains(lower(html), {q(V.structured_marker)}) OR {any_word('low_body', V.job_phrases)} AS has_signal FROM site_pages_feat",
    "json_ld_jobs": (
        "SELECT 'P' || page_id AS company_business_id, 'Urgent role ' || page_id AS job_title, regexp_extract(url, '^([^:]+://[^/?#]*)', 1) || '/jobs/' || page_id AS job_url, 'City ' || page_id AS location_text, 'full-time' AS employment_type, '2024-01-01' AS posted_date, 'Bring high' || chr(160) || 'spirits' AS description_snippet, 'data|it_support' AS tags FROM site_pages WHERE page_id % 4 IN (0, 1)"
        " UNION ALL SELECT 'P' || page_id, 'Low ' || page_id, url, NULL, NULL, NULL, '', 'oppisopimus' FROM site_pages WHERE page_id % 4 IN (1, 2)"
    ),
    "feed_jobs": (
        "SELECT k AS company_business_id, 'Role ' || k AS job_title, 'https://l.example/' || k AS job_url, 'Lahti' AS location_text, 'Full' AS employment_type, '1700000000000' AS posted_date, o_orderpriority AS description_snippet, 'lever' AS source, " + joined(detect("o_orderpriority", TAG_RULES)) + " AS tags FROM (SELECT *, CAST(o_orderkey AS VARCHAR) AS k FROM orders) WHERE o_orderkey % 4 = 0"
        " UNION ALL SELECT k, 'Job ' || k, 'https://g.example/' || k, 'Espoo', NULL, '2024-02-03', o_orderpriority || ' & more', 'greenhouse', " + joined(detect("o_orderpriority", TAG_RULES)) + " FROM (SELECT *, CAST(o_orderkey AS VARCHAR) AS k FROM orders) WHERE o_orderkey % 4 = 1"
        " UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'Second ' || o_orderkey, '', NULL, NULL, NULL, '', 'greenhouse', '' FROM orders WHERE o_orderkey % 4 = 1"
        " UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 'Offer ' || o_orderkey, 'https://r.example/' || o_orderkey, 'Turku', NULL, '2024-03-04', '', 'recruitee', '' FROM orders WHERE o_orderkey % 4 = 2"
    ),
    "generic_jobs": "SELECT 'P' || page_id AS company_business_id, " + authority("url") + " AS company_domain, job_title, job_url, snippet AS description_snippet, array_to_string(tags, '|') AS tags FROM (SELECT DISTINCT o.page_id, p.url, o.job_title, o.job_url, o.snippet, o.tags FROM opened o JOIN site_pages p ON p.page_id = o.page_id WHERE NOT o.is_consent)",
    "generic_job_errors": "SELECT page_id, error, count(*) AS n FROM (SELECT page_id, skipped AS error FROM list_skips WHERE skipped IS NOT NULL UNION ALL SELECT page_id, 'cookie_consent' FROM opened WHERE is_consent) GROUP BY 1, 2",
    "career_suggestion": "SELECT s.business_id, s.name, s.domain AS homepage_domain, c.u AS suggested_base_url, c.source, c.confidence, c.reason FROM sites s JOIN (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY rk, ord) AS rn FROM suggested) c ON c.business_id = s.business_id AND c.rn = 1",
    "dossier_markdown": (
        "SELECT run_id, '# ' || coalesce(nullif(dom, ''), 'Unknown company') || CASE WHEN dom <> '' THEN chr(10) || 'Domain: `' || dom || '`' ELSE '' END || CASE WHEN web <> '' THEN chr(10) || 'Website: [' || web || '](' || web || ')' ELSE '' END"
        " || chr(10) || 'Maps: [Open in Google Maps](' || maps_url || ')' || chr(10) || chr(10) || '**Decision:** ' || upper(hs) || ' (confidence ' || printf('%.2f', hc) || ')'"
        " || CASE WHEN st <> 'ok' THEN chr(10) || 'Pipeline status: ' || st ELSE '' END || CASE WHEN reason <> 'none' THEN chr(10) || 'Degraded reason: ' || reason ELSE '' END || chr(10) || chr(10)"
        f" || '## Why' || {NL} || {bullet_lines('why', 'No strong deterministic signals found.')} || {NL} || {NL} || '## Evidence - Hiring' || {NL} || {bullet_lines('ev', 'No evidence captured.')} || {NL} || {NL}"
        f" || '## Evidence - Industry' || {NL} || '- No evidence captured.' || {NL} || {NL} || '## Evidence - Roles' || {NL} || '- No evidence captured.' || {NL} || {NL}"
        f" || '## Unknowns & Caveats' || {NL} || {bullet_lines('list_concat(list_concat(wl, sk), list_concat(er, nx))', 'No major caveats recorded.')} || {NL} || {NL}"
        f" || CASE WHEN len(nt) > 0 THEN '## Notes' || {NL} || {bullet_lines('nt', '')} || {NL} || {NL} ELSE '' END"
        f" || '## Provenance' || {NL} || '- run_id: ' || run_id || {NL} || '- version: 1.0' || {NL} || '- timestamp: 2024-01-01T00:00:00Z' || {NL} || '- git_sha: ' || {NL} || '- website_source: ' || ws || {NL} AS markdown FROM dossier"
    ),
    "page_verdict": f"SELECT page_id, signal, confidence, evidence, {joined('ev_snippets')} AS snippets, {joined('ev_urls')} AS urls FROM ats_pages_verdict",
    "evidence_gate": f"SELECT answer_id, signal, confidence, evidence, {joined('es')} AS snippets, {joined('eu')} AS urls FROM verdicts",
    "best_verdict": "SELECT business_key, answer_id, signal, confidence FROM (SELECT *, row_number() OVER (PARTITION BY business_key ORDER BY CASE signal WHEN 'yes' THEN 2 WHEN 'unclear' THEN 1 ELSE 0 END DESC, confidence DESC, answer_id) AS rn FROM verdicts) WHERE rn = 1",
    "evidence_downgrade": (
        "SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 'no' WHEN page_id % 7 = 1 THEN 'uncertain' WHEN page_id % 4 IN (0, 3) THEN 'yes' WHEN page_id % 4 = 1 THEN 'maybe' ELSE 'uncertain' END AS hiring_status,"
        " CASE WHEN page_id % 7 < 2 OR page_id % 4 IN (0, 3) THEN 0.9e0 WHEN page_id % 4 = 1 THEN 0.5e0 ELSE 0.2e0 END AS hiring_confidence, CASE WHEN page_id % 7 < 2 OR page_id % 4 IN (0, 3) THEN '' ELSE 'insufficient_evidence_urls' END AS reasons FROM site_pages"
    ),
    "cookie_wall_company": f"SELECT host AS business_id, page_id, round(score, 6) AS wall_score, {joined('signals')} AS signals FROM (SELECT w.*, {authority('url')} AS host, row_number() OVER (PARTITION BY {authority('url')} ORDER BY score DESC, page_id) AS rn FROM site_pages_walls w WHERE is_wall) WHERE rn = 1",
    "hiring_signal": (
        "SELECT 'run1' AS run_id, s.business_id, s.name, s.domain, coalesce(b.signal, 'unclear') AS signal, coalesce(b.confidence, 0e0) AS confidence, coalesce(b.evidence, '') AS evidence, coalesce(array_to_string(b.es, '|'), '') AS snippets, coalesce(array_to_string(b.eu, '|'), '') AS urls, coalesce(b.address, '') AS signal_url,"
        f" l.checked_urls, l.errors, CASE WHEN l.results_found THEN '' ELSE l.skipped END AS skipped_reason, left(sha256({q(rules.PROMPT_TEXT)}), 8) AS prompt_version, true AS llm_used, 'csv' AS output_format FROM sites s JOIN site_lists l ON l.business_id = s.business_id LEFT JOIN site_best b ON b.business_id = s.business_id"
    ),
    "company_package": (
        "SELECT run_id, CASE outcome WHEN 'ok' THEN 'ok' WHEN 'invalid_maps_url' THEN 'error' WHEN 'places_lookup_failed' THEN 'error' ELSE 'degraded' END AS status, CASE WHEN outcome IN ('ok', 'invalid_maps_url', 'places_lookup_failed') THEN 'none' ELSE outcome END AS degraded_reason,"
        " CASE WHEN host_ok THEN coalesce(place_id, '') ELSE '' END AS place_id, CASE WHEN live THEN domain ELSE '' END AS canonical_domain,"
        " CASE WHEN NOT live THEN 'uncertain' WHEN yes AND eligible >= 2 THEN 'yes' WHEN yes AND eligible = 1 THEN 'maybe' ELSE 'uncertain' END AS hiring_status,"
        " CASE WHEN NOT live THEN 0e0 WHEN yes AND eligible = 1 THEN least(confidence, 0.5e0) WHEN yes AND eligible = 0 THEN least(confidence, 0.2e0) ELSE confidence END AS hiring_confidence,"
        " CASE WHEN NOT live THEN '' ELSE array_to_string(list_filter([nullif(evidence, ''), CASE WHEN yes AND eligible < 2 THEN 'insufficient_evidence_urls' END], lambda x: x IS NOT NULL), '|') END AS signals,"
        " CAST(CASE WHEN live THEN len(es) ELSE 0 END AS BIGINT) AS n_evidence, CASE WHEN live THEN safe_errors WHEN outcome = 'places_lookup_failed' THEN 'places_lookup_failed:' || lookup_error ELSE outcome END AS errors,"
        " coalesce(wall, false) AS wall, CASE WHEN outcome IN ('place_id_not_found', 'website_missing') THEN 'Paste official website URL to proceed.' WHEN outcome = 'cookie_wall' THEN 'Cookie wall detected. Open site manually and retry.' ELSE '' END AS next_action,"
        " CASE WHEN NOT live THEN outcome END AS error_code FROM package_live"
    ),
    "package_schema_violations": (
        "SELECT page_id, CASE page_id % 14 WHEN 0 THEN 'invalid status odd ' || page_id WHEN 1 THEN 'wrong type hiring.confidence: string' WHEN 2 THEN 'wrong type hiring.evidence[0].snippet: integer'"
        " WHEN 3 THEN 'missing git_sha' WHEN 4 THEN 'wrong type safety.cookie_wall.threshold.hits_min: number' WHEN 5 THEN 'wrong type notes.tags[1]: null' WHEN 6 THEN 'missing hiring.evidence[1].url'"
        " WHEN 7 THEN 'missing source.place_id' WHEN 8 THEN 'wrong type safety.llm_used: string' WHEN 9 THEN 'wrong type safety.pages_fetched: array' WHEN 10 THEN 'not a JSON document'"
        " ELSE 'wrong type links: integer' END AS violation FROM site_pages WHERE page_id % 14 < 12"
    ),
    "bad_lines": (
        "SELECT CASE WHEN k > 4 THEN '' ELSE 'f' || o_orderkey % 2 END AS file, CASE WHEN k > 4 THEN 'row' WHEN k = 2 THEN 'value of another type' ELSE 'no JSON object' END AS reason,"
        " count(*) AS n_lines FROM (SELECT o_orderkey, o_orderkey % 9 AS k FROM orders) WHERE k <> 3 GROUP BY 1, 2"
    ),
    "edit_examples": "SELECT business_id, array_to_string(fields, '|') AS changed_fields FROM changed WHERE len(fields) > 0 ORDER BY business_id LIMIT 5",
    "industry_filter": f"SELECT business_id, main_business_line FROM companies WHERE {gate('main_business_line', ['62', '1'], ['47', '5.'], 'pass')}",
    "shortlist_and_excluded": f"SELECT business_id, {excluded('company_form', 'name')} AS excluded_reason FROM companies",
    "transliterate": (
        "SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'Thessalonike ' WHEN 1 THEN 'Shchiolkovo ' WHEN 2 THEN 'Kiyiv ' WHEN 3 THEN 'Full ' WHEN 4 THEN 'fin EUR'"
        " WHEN 5 THEN 'Lodz - ' WHEN 6 THEN '東京 ' ELSE 'plain ' END || c_custkey AS ascii FROM customer"
    ),
    "package_violations": "SELECT CAST(NULL AS VARCHAR) AS run_id, CAST(NULL AS VARCHAR) AS violation FROM site_pages WHERE false",
    "contract_violations": (
        "SELECT answer_id, unnest(list_filter([CASE answer_id % 4 WHEN 1 THEN 'invalid signal perhaps' END, CASE WHEN answer_id % 10 = 0 THEN 'invalid output_format xml' END, CASE WHEN answer_id % 3 = 1 THEN 'invalid list column evidence_snippets' END,"
        " CASE WHEN answer_id % 9 = 0 THEN 'invalid deterministic' END, CASE WHEN answer_id % 8 = 2 THEN 'invalid llm_used' END, CASE WHEN answer_id % 6 = 2 THEN 'invalid confidence' END, CASE WHEN answer_id % 6 IN (1, 3) THEN 'confidence out of range' END,"
        " CASE WHEN answer_id % 7 = 0 THEN 'invalid ollama_temperature' END, CASE WHEN answer_id % 5 = 1 THEN 'invalid max_distance_km' END], lambda x: x IS NOT NULL)) AS violation FROM model_answers"
    ),
    "activity_sliding": "SELECT user_id, strftime(day - CAST(k AS INT), '%Y-%m-%d') AS window_start, CAST(sum(n) AS BIGINT) AS n_events FROM (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), range(30) r(k) GROUP BY 1, 2",
    "company_run": "SELECT business_id, name, city, industry, nearest_station, round(distance_km, 6) AS distance_km, total AS score, reasons AS score_reasons FROM ("
    + score_sql(
        f"SELECT n.business_id, n.name, n.city, {industry('CAST(n.ord * 13 % 90 + 10 AS VARCHAR)')} AS industry, CAST(n.ord * 13 % 90 + 10 AS VARCHAR) AS line, r.station_name AS nearest_station, r.km AS distance_km, {excluded('NULL', 'n.name')} AS excluded FROM normalized2 n LEFT JOIN run_near r ON r.business_id = n.business_id AND r.rn = 1",
        ["62", "1"], ["47"], "line",
    )
    + ") WHERE excluded IS NULL",
}
CTES["run_ladder"] = (
    f"SELECT c.business_id, c.name, c.ord, CAST(NULL AS VARCHAR) AS website_url, coalesce({usable("CASE WHEN c.ord % 5 = 0 THEN c.domain END")}, s.domain, '') AS domain, c.nearest_station, c.distance_km"
    " FROM shortlist c LEFT JOIN sites s ON s.ord = c.ord"
)
CTES["run_targets"] = "SELECT * FROM run_ladder WHERE lower(nearest_station) = 'nation_3' AND distance_km <= 400 AND trim(domain) <> ''"
CTES |= scan_ctes("run", "run_targets", SITE_PATHS)
STATEMENTS |= {
    "domain_map_rows": f"SELECT business_id, {clean_domain('website_url')} AS domain FROM companies WHERE ord % 10 <> 0 AND {clean_domain('website_url')} <> ''",
    "station_rows": "SELECT n_name AS station_name, round(60e0 + n_nationkey * 0.2e0, 6) AS lat FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey % 5 <> 0",
    "signal_csv_rows": "SELECT answer_id, CAST(to_json(es) AS VARCHAR) AS evidence_snippets, CAST(to_json(eu) AS VARCHAR) AS evidence_urls FROM verdicts",
    "known_jobs_state": "SELECT job_url, fp AS job_fingerprint FROM distinct_jobs UNION SELECT job_url, fp FROM known",
    "outreach_rows": "SELECT business_id, name FROM shortlist WHERE score >= 5",
    "audit_row": "SELECT '2024-02-01T00:00:00' AS ts, 'b1' AS batch_id, count(*) FILTER (len(fields) > 0) AS changed_rows, 'm2' AS source_master, 'overlay' AS curation_path, CAST(NULL AS VARCHAR) AS backup_path FROM changed",
    "scan_run": (
        "SELECT s.business_id, s.domain, coalesce(b.signal, 'unclear') AS signal, coalesce(b.confidence, 0e0) AS confidence, l.checked_urls, l.errors, CASE WHEN l.results_found THEN '' ELSE l.skipped END AS skipped_reason"
        " FROM run_targets s JOIN run_lists l ON l.business_id = s.business_id LEFT JOIN run_best b ON b.business_id = s.business_id"
    ),
}
STATEMENTS["hiring_signal_answers"] = STATEMENTS["hiring_signal"].replace("site_lists", "ans_lists").replace("site_best", "ans_best")
ORACLES = {name: sql(text) for name, text in STATEMENTS.items()}
