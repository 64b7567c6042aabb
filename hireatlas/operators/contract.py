"""Contract checks that list every violation as a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hireatlas import rules, schemas
from hireatlas.functions.text import filled
from hireatlas.functions.values import parse_bool, parse_list
from hireatlas.operators.json_schema import schema_violations

TEXT, NUMBER, WHOLE, FLAG = ({"type": kind} for kind in ("string", "number", "integer", "boolean"))
TEXTS, OBJECTS = {"type": "array", "items": TEXT}, {"type": "array", "items": {"type": "object"}}


def _one_of(*values: str) -> dict:
    return TEXT | {"enum": list(values)}


def _whole(**properties: dict) -> dict:
    """An object that needs all of its properties."""
    return {"type": "object", "required": list(properties), "properties": properties}


def _open(**properties: dict) -> dict:
    return {"type": "object", "properties": properties}


# The names, types and allowed words of a company package.
PACKAGE_SCHEMA = _whole(
    status=_one_of("ok", "degraded", "error"),
    degraded_reason=_one_of("none", "place_id_not_found", "website_missing", "cookie_wall", "robots_disallowed", "js_only", "fetch_timeout"),
    schema_version=TEXT,
    run_id=TEXT,
    created_at=TEXT,
    tool_version=TEXT,
    git_sha=TEXT,
    source=_whole(
        source_ref=TEXT, place_id=TEXT, canonical_domain=TEXT, website_source=_one_of("user", "places", "inferred_search", "unknown"), resolver_notes=TEXT
    ),
    hiring=_whole(
        status=_one_of("yes", "no", "maybe", "uncertain"), confidence=NUMBER, signals=TEXTS, evidence={"type": "array", "items": _whole(snippet=TEXT, url=TEXT)}
    ),
    links=_whole(maps_url=TEXT, website_url=TEXT, careers_urls=TEXTS, ats_urls=TEXTS, contact_url=TEXT),
    next_action=TEXT,
    safety=_whole(
        robots_respected=_one_of("true", "false", "unknown"),
        pages_fetched=WHOLE,
        skipped_reasons=TEXTS,
        errors=TEXTS,
        checked_urls=TEXTS,
        cookie_wall={
            "type": "object",
            "required": ["detected", "score", "hit_count", "signals", "threshold", "matches"],
            "properties": dict(
                detected=FLAG, score=NUMBER, hit_count=WHOLE, signals=TEXTS, matches=TEXTS, sample_title=TEXT,
                threshold=_whole(hits_min=WHOLE, score_min=NUMBER, text_max_len=WHOLE, hits_hard=WHOLE),
            ),
        },
        llm_used=FLAG,
        prompt_version=TEXT,
        ollama_model=TEXT,
        ollama_temperature=NUMBER,
        deterministic=FLAG,
    ),
    notes=_whole(note=TEXT, tags=TEXTS),
)
PACKAGE_SCHEMA["properties"] |= {
    "industry": _open(labels=TEXTS, confidence=NUMBER, evidence=OBJECTS),
    "roles": _open(detected=TEXTS, fit=_open(score=NUMBER, green_flags=TEXTS, red_flags=TEXTS, evidence=OBJECTS)),
    "error": _open(code=TEXT, message=TEXT),
}


def _violations(df: DataFrame, key: str, messages: list[Column]) -> DataFrame:
    """One row per message that is not null."""
    # The outer form evaluates the checks once; rows without a violation are dropped after it.
    return df.select(key, F.explode_outer(F.array_compact(F.array(*messages))).alias("violation")).where("violation IS NOT NULL")


def signal_violations(df: DataFrame, key: str) -> DataFrame:
    """Violations of the hiring-signal contract, for typed rows as well as all-text rows."""
    types = dict(df.dtypes)
    messages = [F.lit(f"missing column {c}") for c in schemas.SIGNAL_COLUMNS if c not in types]

    def text(c: str) -> Column:
        return F.col(c).cast("string") if c in types else F.lit(None).cast("string")

    for column, allowed in (("signal", rules.SIGNALS), ("output_format", rules.OUTPUT_FORMATS)):
        value = F.lower(filled(text(column)))
        messages.append(F.when(~value.isin(allowed), F.concat(F.lit(f"invalid {column} "), value)))
    for column in ("evidence_snippets", "evidence_urls"):
        if not types.get(column, "array").startswith("array"):
            messages.append(F.when(parse_list(column).isNull(), F.lit(f"invalid list column {column}")))
    if "deterministic" in types:
        given = text("deterministic")
        messages.append(F.when(given.isNotNull() & parse_bool(given).isNull(), F.lit("invalid deterministic")))
    messages.append(F.when(parse_bool(text("llm_used")).isNull(), F.lit("invalid llm_used")))
    for column in ("confidence", "ollama_temperature", "max_distance_km"):
        given = filled(text(column))
        number = given.try_cast("double")
        messages.append(F.when(given.isNotNull() & number.isNull(), F.lit(f"invalid {column}")))
        if column == "confidence":
            messages.append(F.when((number < 0) | (number > 1), F.lit("confidence out of range")))
    return _violations(df, key, messages)


def package_violations(df: DataFrame, key: str = "run_id", package: str = "package") -> DataFrame:
    """Violations of the company package contract; ``package`` is the JSON text of a document."""
    return schema_violations(df, PACKAGE_SCHEMA, key, package)
