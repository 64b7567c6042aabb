"""Test-data binding: the given tables read as companies, postings, pages, logs and edits.

Every derived input is a list of projections over one given table. The projections use only syntax
that Spark SQL and the checking engine share, so both sides start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from hireatlas.operators.once import spread
from hireatlas.operators.pages import Vocabulary

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def pick(key: str, *values: str | None) -> str:
    """CASE over ``key`` modulo the number of values; None is a null text."""
    cases = " ".join(
        f"WHEN {i} THEN " + ("CAST(NULL AS STRING)" if v is None else v) for i, v in enumerate(values)
    )
    return f"(CASE ({key}) % {len(values)} {cases} END)"


def text(key: str) -> str:
    return f"CAST({key} AS STRING)"


def company_id(key: str) -> str:
    return f"(lpad({text(key)}, 7, '0') || '-' || {text(f'({key}) % 10')})"


CITY = pick("c_custkey", "'Lahti'", "'Mäntsälä'", "' Hämeenlinna'", "'JYVÄSKYLÄ'", "'Åbo'")
WEBSITE = pick(
    "c_custkey",
    None,
    f"'https://www.c' || {text('c_custkey')} || '.example/path?x=1'",
    f"'c' || {text('c_custkey')} || '.example'",
    "''",
    "'NaN'",
    f"'http://C' || {text('c_custkey')} || '.Example:8080/'",
)

BINDINGS: dict[str, tuple[str, list[str]]] = {
    "stations": (
        "nation",
        [
            "CAST(n_nationkey AS BIGINT) AS ord",
            "n_name AS station_name",
            "60e0 + n_nationkey * 0.2e0 AS lat",
            "22e0 + (n_nationkey * 7 % 25) * 0.3e0 AS lon",
        ],
    ),
    "companies": (
        "customer",
        [
            "c_custkey AS ord",
            f"{company_id('c_custkey')} AS business_id",
            pick(
                "c_custkey", "'Asunto Oy ' || c_name", "'AS. OY Kotikatu ' || c_name", "'Kiinteistö  Oy ' || c_name",
                "'Oy Asuntola ' || c_name", "c_name", "c_name", "c_name || ' Asunto-Osakeyhtiö'", "'Kasoy ' || c_name", "c_name",
            )
            + " AS name",
            f"{CITY} AS city",
            pick("c_custkey", "'Lahti'", None) + " AS _source_city",
            pick("c_custkey", "'Turku'", "'Lahti'", None) + " AS domicile",
            pick("c_custkey", "'Asunto-osakeyhtiö'", "'OY'", "'OYJ'", "'AS OY'", "' oy '", None, "'OY'", "'OY'", "'OY'", "'OY'", "'OY'")
            + " AS company_form",
            f"({text('(c_custkey * 13) % 90 + 10')} || '.' || {text('c_custkey % 10')}) AS main_business_line",
            "(CASE WHEN c_custkey % 11 = 0 THEN CAST(NULL AS DOUBLE) ELSE 60e0 + (c_custkey * 37 % 500) / 100e0 END) AS lat",
            "(CASE WHEN c_custkey % 11 = 0 THEN CAST(NULL AS DOUBLE) ELSE 22e0 + (c_custkey * 53 % 750) / 100e0 END) AS lon",
            "(CASE WHEN c_custkey % 17 = 0 THEN CAST(NULL AS DOUBLE) ELSE floor(c_acctbal / 500e0) * 1e0 END) AS score",
            f"{WEBSITE} AS website_url",
            pick("c_custkey", None, "''", f"'own' || {text('c_custkey')} || '.example'", "'none'") + " AS domain",
            pick("c_custkey", "'shortlist'", "'neutral'", "'excluded'", None) + " AS status",
            "(CASE WHEN c_custkey % 19 = 0 THEN true WHEN c_custkey % 19 = 1 THEN CAST(NULL AS BOOLEAN) ELSE false END) AS hide_flag",
            pick("c_custkey", "'name_match:housing'", "''", None, None, None, None, None, None) + " AS excluded_reason",
            pick("c_custkey", "'data;it'", "'Data, AI ,data'", "''", None, "'ml;salesforce;IT'", "'junior'") + " AS tags",
            pick("c_custkey", "'Call back ' || c_mktsegment", None, "''", "'Met at the fair. ' || repeat(c_name || ' ', 9)") + " AS note",
            "(c_custkey % 3 = 0) AS recruiting_active",
            "c_custkey % 12 AS job_count_total",
            "(CASE WHEN c_custkey % 5 = 0 THEN c_custkey % 4 ELSE 0 END) AS job_count_new_since_last",
        ],
    ),
    "registry": (
        "customer",
        [
            "c_custkey AS ord",
            f"{company_id('c_custkey')} AS business_id",
            "'Row ' || c_name AS plain_name",
            pick("c_custkey", "'Lahti'", "'Turku'", None, "'Espoo'") + " AS _source_city",
            pick("c_custkey", "'Domi'", None) + " AS domicile",
            # two addresses
            pick("c_custkey", "'Katu ' || c_mktsegment", None, "' '") + " AS street0",
            pick("c_custkey", "'00100'", "'33100'", None, "''") + " AS post0",
            pick("c_custkey", "'Espoo'", "'Lahti'", None, "'Turku'", "'Åbo'") + " AS city0",
            pick("c_custkey", None, "'Tori ' || c_mktsegment", "'Ranta'") + " AS street1",
            pick("c_custkey", "'15100'", None, "'20100'", None, None) + " AS post1",
            pick("c_custkey", "'Lahti'", "'Turku'", "'Espoo'") + " AS city1",
            # three names: type, registration, end
            "'Nimi A' || c_name AS name0",
            pick("c_custkey", "'1'", "'2'") + " AS type0",
            pick("c_custkey", "'2001-01-01'", None, "'2015-05-05'") + " AS reg0",
            pick("c_custkey", None, "'2010-01-01'", "''", None) + " AS end0",
            "'Nimi B' || c_name AS name1",
            pick("c_custkey", "'2'", "'1'", "'1'") + " AS type1",
            pick("c_custkey", "'2003-03-03'", "'2001-01-01'") + " AS reg1",
            pick("c_custkey", "'2012-01-01'", None, None) + " AS end1",
            "'Nimi C' || c_name AS name2",
            pick("c_custkey", "'1'", "'3'", None) + " AS type2",
            pick("c_custkey", "'2001-01-01'", "'2020-02-02'", None, "'2011-01-01'") + " AS reg2",
            pick("c_custkey", None, None, "'2021-01-01'", None, None) + " AS end2",
        ],
    ),
    "overlay": (
        "customer",
        [
            f"{company_id('c_custkey')} AS business_id",
            pick("c_custkey", "'shortlist'", None, "'excluded'", "'neutral'") + " AS status",
            "(CASE WHEN c_custkey % 21 = 0 THEN true WHEN c_custkey % 6 = 0 THEN false ELSE CAST(NULL AS BOOLEAN) END) AS hide_flag",
            pick("c_custkey", "'edited ' || c_mktsegment", None) + " AS note",
            pick("c_custkey", "'it'", "' '", None, "'retail'", None) + " AS industry_override",
            pick("c_custkey", "'ai;ML'", None, "'New, new'") + " AS tags_add",
            pick("c_custkey", "'data'", None, None, "'IT;ai'") + " AS tags_remove",
            "'2024-01-01' AS updated_at",
            "'first' AS updated_by",
            pick("c_custkey", "'master_20240101'", None) + " AS source_master",
            "(c_custkey % 3 = 0) AS listed",
        ],
    ),
    "edits_a": (
        "customer",
        [
            f"{company_id('c_custkey')} AS business_id",
            pick("c_custkey", "'shortlist'", "'excluded'", None) + " AS status",
            "(c_custkey % 10 = 0) AS hide_flag",
            "'a ' || c_mktsegment AS note",
            pick("c_custkey", "'marketing'", None) + " AS industry_override",
            pick("c_custkey", "'One; two,one'", "''", None) + " AS tags_add",
            pick("c_custkey", None, "'Data'") + " AS tags_remove",
            "(c_custkey % 4 = 0) AS listed",
        ],
    ),
    "edits_b": (
        "customer",
        [
            f"{company_id('c_custkey')} AS business_id",
            "'neutral' AS status",
            "CAST(NULL AS BOOLEAN) AS hide_flag",
            "'b ' || c_name AS note",
            "CAST(NULL AS STRING) AS industry_override",
            "'three' AS tags_add",
            "CAST(NULL AS STRING) AS tags_remove",
            "(c_custkey % 6 = 0) AS listed",
        ],
    ),
    "jobs_raw": (
        "orders",
        [
            "o_orderkey AS ord",
            f"{company_id('o_custkey')} AS company_business_id",
            pick("o_orderkey", None, "' '", f"'Company ' || {text('o_custkey')}", f"'Company ' || {text('o_custkey')}") + " AS company_name",
            f"('c' || {text('o_custkey')} || '.example') AS company_domain",
            pick("o_orderkey", "'Senior  ' || o_orderpriority", "o_orderpriority || ' Specialist '", "'  ' || lower(o_orderpriority)") + " AS job_title",
            f"('https://c' || {text('o_custkey')} || '.example/jobs/' || {text('o_orderkey % 7')}) AS job_url",
            pick("o_orderkey", "'Lahti, Finland'", "'LAHTI'", "'Helsinki, Suomi'", None) + " AS location_text",
            pick("o_orderkey", "'full-time'", None) + " AS employment_type",
            "(CASE WHEN o_orderkey % 13 = 0 THEN CAST(CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) * 86400000 AS STRING)"
            " WHEN o_orderkey % 29 = 0 THEN 'not a date' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END) AS posted_date",
            "('Order ' || o_orderstatus || ' ' || o_orderpriority) AS description_snippet",
            "'feed' AS source",
            "o_orderdate",
        ],
    ),
    "fetch_log": (
        "events",
        [
            f"('d' || {text('user_id')} || '.example') AS domain",
            "event_id AS seq",
            "ts",
            f"('https://d' || {text('user_id')} || '.example/' || event_type || '/' || {text('event_id % 50')}) AS url",
            f"('https://d' || {text('user_id')} || '.example/' || event_type || '/' || {text('event_id % 50')} || (CASE event_id % 9 WHEN 0 THEN '/' WHEN 1 THEN '/new' ELSE '' END)) AS final_url",
            "(CASE WHEN event_type = 'error' THEN CAST(NULL AS INT) WHEN event_type = 'signup' AND event_id % 3 = 0 THEN CAST((CASE event_id % 4 WHEN 0 THEN 404 WHEN 1 THEN 429 WHEN 2 THEN 503 ELSE 403 END) AS INT) ELSE 200 END) AS status_code",
            "CAST(value * 20000 AS BIGINT) AS n_bytes",
            "(CASE WHEN event_type <> 'error' THEN CAST(NULL AS STRING) ELSE "
            + "(CASE user_id % 6 WHEN 0 THEN "
            + pick("event_id", "'listing_url_skipped'", "'non_job_url_skipped'")
            + " WHEN 1 THEN "
            + pick("event_id", "'cookie_consent'", "'listing_url_skipped'", "'cookie_consent'")
            + " WHEN 2 THEN "
            + pick("event_id", "'timeout'", "'dns'", "'timeout'")
            + " WHEN 3 THEN "
            + pick("event_id", "'robots_disallow_url'", "'http_403'")
            + " WHEN 4 THEN "
            + pick("event_id", "'robots_disallow_all'", "'timeout'", None)
            + " WHEN 5 THEN 'fetch_failed:' || 'https://d' || CAST(user_id AS STRING) || '.example/' || CAST(event_id AS STRING)"
            + " ELSE CAST(NULL AS STRING) END) END) AS error",
            "CAST((CASE WHEN event_type = 'purchase' AND user_id % 4 = 0 AND value > 20 THEN 1 ELSE 0 END) AS BIGINT) AS jobs",
            "(CASE WHEN event_type = 'error' AND user_id % 6 = 4 THEN 'robots_disallow_all' WHEN event_type = 'error' AND user_id % 30 = 5 THEN 'base_fetch_failed' ELSE CAST(NULL AS STRING) END) AS skipped_reason",
            "(CASE WHEN event_type = 'purchase' THEN 'jsonld' WHEN event_type = 'click' AND user_id % 5 = 0 THEN 'generic' ELSE CAST(NULL AS STRING) END) AS extractor",
            "(CASE WHEN event_type = 'click' AND user_id % 8 = 0 THEN (CASE event_id % 2 WHEN 0 THEN 'lever' ELSE 'greenhouse' END) ELSE CAST(NULL AS STRING) END) AS ats_detected",
            "(CASE WHEN event_type = 'click' AND user_id % 8 = 0 THEN event_id % 5 = 0 ELSE CAST(NULL AS BOOLEAN) END) AS ats_fetch_ok",
            "(CASE WHEN event_type = 'click' AND user_id % 8 = 0 AND event_id % 5 = 1 THEN 'no_postings' WHEN event_type = 'click' AND user_id % 8 = 0 AND event_id % 5 = 2 THEN 'http_500' ELSE CAST(NULL AS STRING) END) AS ats_fetch_reason",
        ],
    ),
    "places": (
        "orders",
        [
            "o_orderkey AS ord",
            f"(CASE WHEN o_custkey % 50 = 0 THEN '' ELSE 'P' || {text('o_custkey')} END) AS place_id",
            f"'Place ' || {text('o_custkey')} AS name",
            pick(
                "o_orderkey", f"'Katu ' || {text('o_orderkey % 90')} || ', 15100 Lahti, Finland'", "'Lahti'",
                "'Tori 1, 00100 Helsinki , Suomi'", "', ,'", None, "'Kuja 2, Vantaa'", "'33100'",
            )
            + " AS formatted_address",
            "(CASE WHEN o_orderkey % 23 = 0 THEN CAST(NULL AS DOUBLE) ELSE 60e0 + (o_custkey * 37 % 500) / 100e0 END) AS lat",
            "22e0 + (o_custkey * 53 % 750) / 100e0 AS lon",
            f"'https://p' || {text('o_custkey')} || '.example' AS website",
            "o_orderkey % 25 AS station_key",
        ],
    ),
    "model_answers": (
        "conversations",
        [
            "conv_id * 100 + turn AS answer_id",
            "conv_id % 40 AS business_key",
            "turn",
            # A model writes around its JSON: the words of the conversation, without braces of their own.
            "(translate(coalesce(text, ''), '{}', '()') || ' ' || "
            + pick(
                "conv_id",
                "'Sure: {\"hiring_signal\":\"Yes\",\"confidence\":0.' || ((conv_id + turn) % 10) || ',\"evidence\":\"list ' || turn || '\",\"evidence_snippets\":[\"we are hiring now ' || conv_id || '\",\"open roles here\"],\"evidence_urls\":[\"https://a.example/x' || conv_id || '\"]} Bye'",
                "'{\"hiring_signal\":\"no\",\"confidence\":0.' || ((conv_id * 3 + turn) % 10) || ',\"evidence\":\"none\",\"evidence_snippets\":[\"no vacancies today\",\" \",\"closed ' || turn || '\"],\"evidence_urls\":[\"https://b.example/' || turn || '\"]}'",
                "'{\"hiring_signal\":\"yes\",\"confidence\":0.' || ((conv_id * 7) % 10) || ',\"evidence\":\"vague\",\"evidence_snippets\":[\"great people ' || conv_id || '\",\"nice office\"],\"evidence_urls\":[\"https://c.example\"]}'",
                "'note {\"hiring_signal\":\"yes\",\"confidence\":0.6,\"evidence\":\"one\",\"evidence_snippets\":[\"apply here\"],\"evidence_urls\":[]} end'",
                "'{\"hiring_signal\":\"unclear\",\"confidence\":0.1,\"evidence\":\"\"}'",
                "'no json, only { an open brace'",
                "'{\"hiring_signal\":\"no\",\"confidence\":0.5,\"evidence\":\"x\",\"evidence_snippets\":[\"about us\",\"our story\"],\"evidence_urls\":[\"https://d.example\"]}'",
            )
            + " || ' ' || translate(coalesce(text, ''), '{}', '()')) AS answer",
        ],
    ),
    "site_pages": ("pages", ["page_id", "url", "html"]),
}

# Corpus words that do occur in the pages, in place of the hiring vocabulary, which does not.
VOCABULARY = Vocabulary(
    evidence=["thon", "thble", "than", "ment", "sch", "ing"],
    negative=["nicht", "pas"],
    job_phrases=["that", " que ", "der "],
    structured_marker="&quot;",
    cookie_words=["thth", "thand", "oiç", "éan", "ein ", "los ", "ción"],
    cookie_signals={"banner": ["thth", "oiç"], "manager": ["éan", "ein "], "actions": ["thand", "los "]},
    cookie_limits={"hits_min": 2, "score_min": 0.4, "text_max_len": 2500, "hits_hard": 4},
    consent_words=["with", "was ", "pour", "und ", "para"],
    consent_pair=["the ", "for "],
    tag_rules={"data": ["urgent", "thon"], "it_support": ["high", " le "], "salesforce": ["not specified"], "oppisopimus": ["low", "sch"]},
    url_hints=["/th", "/que", "."],
    text_hints=["ment", "ing"],
    listing_paths=["/the", "/and", "/que", "/de"],
    non_job_paths=["/th", "tion"],
    non_job_queries=["utm_source=", "page="],
)
TAG_RULES = VOCABULARY.tag_rules
SITE_PATHS = ["/en/148.html", "/en/414", "/fr/414", "/en/471", "/es/533"]


_schemas: dict[str, StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; its schema is looked up in the file once, later reads go without that job."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def spark_expr(expr: str) -> str:
    """The one spelling that differs: the unit argument of the day difference."""
    return expr.replace("date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))", "datediff(CAST(o_orderdate AS DATE), DATE '1970-01-01')")


def bound(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, expressions = BINDINGS[name]
    return spread(table(spark, sf_dir, source)).selectExpr(*[spark_expr(e) for e in expressions])


def bound_sql(name: str) -> str:
    source, expressions = BINDINGS[name]
    return f"SELECT {', '.join(expressions)} FROM {source}"
