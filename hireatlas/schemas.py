"""Table schemas and the one place where input frames are aligned with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T


STRINGS = T.ArrayType(T.StringType())
_TYPES = {
    "string": T.StringType(),
    "long": T.LongType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "array<string>": STRINGS,
}


def schema(columns: str) -> T.StructType:
    """Flat schema from ``name type`` pairs; needs no running session."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


# The column names and types of the data contract, of all schemas below and of SIGNAL_COLUMNS.
REGISTRY = T.StructType(
    [
        T.StructField("businessId", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("names", T.ArrayType(schema("name string, type string, registrationDate string, endDate string"))),
        T.StructField("addresses", T.ArrayType(schema("street string, postCode string, city string"))),
        *schema("street string, postCode string, city string, domicile string, _source_city string, companyForm string"),
        T.StructField("companyForms", T.ArrayType(schema("name string, type string"))),
        T.StructField("mainBusinessLine", schema("type string")),
    ]
)
COMPANY = schema(
    "ord long, business_id string, name string, full_address string, street string, post_code string, city string,"
    "_source_city string, domicile string, lat double, lon double, nearest_station string, distance_km double,"
    "website_url string, company_domain string, domain string, score double, score_reasons string, excluded_reason string,"
    "status string, hide_flag boolean, note string, industry_raw string, industry string, main_business_line string,"
    "company_form string, recruiting_active boolean, job_count_total long, job_count_new_since_last long, tags string,"
    "source string"
)
COMPANY_ALIASES = {
    "businessId": "business_id",
    "company_name": "name",
    "place_id": "business_id",
    "website.url": "website_url",
    "website": "website_url",
}
STATION = schema("station_name string, lat double, lon double, uic string, city_name string, country string")
STATION_ALIASES = {"name": "station_name", "latitude": "lat", "longitude": "lon"}
PLACE = schema(
    "place_id string, name string, formatted_address string, lat double, lon double, types string, website string,"
    "business_status string"
)
PLACE_REQUIRED = ["place_id", "name", "formatted_address", "lat", "lon"]
JOB = schema(
    "company_business_id string, company_name string, company_domain string, job_title string, job_url string,"
    "location_text string, employment_type string, posted_date string, description_snippet string, source string,"
    "tags array<string>, crawl_ts string"
)
KNOWN_JOB = schema("job_url string, job_fingerprint string")
ACTIVITY = schema(
    "business_id string, job_count_total long, job_count_last_30d long, job_count_new_since_last long,"
    "recruiting_active boolean, tag_count_data long, tag_count_it_support long, tag_count_salesforce long,"
    "tag_count_oppisopimus long"
)
CRAWL_STATS = schema(
    "domain string, pages_fetched long, jobs_found long, extractor_used string, errors_count long, errors_top string,"
    "skipped_reason string, ats_detected string, ats_fetch_ok boolean, ats_fetch_reason string, robots_rule_hit string,"
    "first_blocked_url string, status string"
)
FETCH_LOG = schema(
    "domain string, seq long, url string, final_url string, status_code int, n_bytes long, error string, jobs long,"
    "skipped_reason string, extractor string"
)
OVERLAY = schema(
    "business_id string, status string, hide_flag boolean, note string, industry_override string, tags_add string,"
    "tags_remove string, updated_at string, updated_by string, source_master string"
)
EDIT_FIELDS = ["status", "hide_flag", "note", "industry_override", "tags_add", "tags_remove"]
DOMAIN_MAP = schema("business_id string, name string, domain string")
EMPLOYEES = schema("business_id string, employee_count int, employee_band string")
GEOCODE_CACHE = schema("address string, lat double, lon double, ts string")
ACCESS_RULE = schema("host string, ord int, path_prefix string, allow boolean, site_state string")
PAGE = schema("page_id long, url string, html string")
FEED = schema("kind string, business_id string, name string, domain string, payload string")
AUDIT = schema(
    "ts string, batch_id string, changed_rows long, source_master string, curation_path string, backup_path string,"
    "diff string"
)
SIGNAL_COLUMNS = [
    "run_id", "tool_version", "git_sha", "crawl_ts", "station", "max_distance_km", "business_id", "name", "domain",
    "signal", "confidence", "evidence", "evidence_snippets", "evidence_urls", "signal_url", "checked_urls",
    "next_url_hint", "errors", "skipped_reason", "ollama_model", "ollama_temperature", "prompt_version", "llm_used",
    "output_format",
]


def conform(df: DataFrame, target: T.StructType, aliases: dict[str, str] | None = None, keep_extra: bool = False) -> DataFrame:
    """Rename aliases, add absent columns as typed nulls, cast, and turn NaN into null."""
    for old, new in (aliases or {}).items():
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    have = {field.name: field.dataType for field in df.schema}
    columns = []
    for field in target:
        if field.name not in have:
            column = F.lit(None).cast(field.dataType)
        else:
            column = F.col(f"`{field.name}`")
            if have[field.name] != field.dataType:
                # Text that does not parse becomes null, also when the session is in ANSI mode.
                column = column.try_cast(field.dataType)
            if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
                column = F.when(~F.isnan(column), column)
        columns.append(column.alias(field.name))
    if keep_extra:
        columns += [F.col(f"`{name}`") for name in df.columns if name not in target.fieldNames()]
    return df.select(*columns)


def require(df: DataFrame, columns: list[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing columns: {', '.join(missing)}")
    return df
