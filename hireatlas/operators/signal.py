"""Hiring verdicts: per page, behind an evidence gate, and the best one per company."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from hireatlas import rules
from hireatlas.functions.keywords import keyword_places, snippets_at
from hireatlas.functions.markup import page_parts
from hireatlas.functions.text import contains_any, literal_array, strip
from hireatlas.functions.urls import is_ats_host, is_first_party
from hireatlas.functions.values import embedded_json, json_text
from hireatlas.operators.companies import first_per_key
from hireatlas.operators.once import compute_once, with_fields
from hireatlas.operators.pages import DEFAULT_VOCABULARY, Vocabulary, detect_ats, has_job_signal

VERDICT = "struct<signal:string,confidence:double,evidence:string,evidence_snippets:array<string>,evidence_urls:array<string>>"


def _verdict(signal: str, confidence: float, evidence: Column, found: Column, urls: Column) -> Column:
    return F.struct(
        F.lit(signal).alias("signal"),
        F.lit(confidence).alias("confidence"),
        evidence.alias("evidence"),
        found.alias("evidence_snippets"),
        urls.alias("evidence_urls"),
    ).cast(VERDICT)


def page_verdict(pages: DataFrame, vocabulary: Vocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """Add the verdict columns to pages. Columns ``title, text, body`` that are there already (`page_parts`) are taken as they are.

    The ladder: a board, then structured data, then job phrases backed by two excerpts, else unclear.
    """
    v = vocabulary
    html = F.col("html")
    absent = [n for n in ("title", "text", "body") if n not in pages.columns]
    rows = compute_once(pages, {"_ats": detect_ats(F.col("url"), html)})
    rows = with_fields(rows, page_parts(html, *absent)) if absent else rows
    # The texts differ in noscript blocks only, which phrases count and excerpts do not.
    rows = compute_once(
        rows,
        {"_words": keyword_places(F.lower("text"), v.evidence), "_phrases": keyword_places(F.lower("body"), v.job_phrases)},
    )
    rows = compute_once(rows, {"_found": snippets_at(F.col("text"), F.col("_words"), v.evidence, 3)})
    none = literal_array([])
    own = F.array("url")
    board = _verdict(
        "yes", 0.9, F.concat(F.lit("ats:"), F.col("_ats.kind")),
        F.array(F.concat(F.lit("ATS detected: "), F.col("_ats.kind")), F.lit("ATS job board link found")), own,
    )
    structured = _verdict(
        "yes", 0.8, F.lit("jobposting_structured_data"),
        F.array(F.lit("JobPosting structured data found"), F.concat(F.lit("Title: "), "title")), own,
    )
    ladder = (
        F.when(F.col("_ats").isNotNull(), board)
        .when(F.contains(F.lower("html"), F.lit(v.structured_marker)), structured)
        .when(
            has_job_signal(F.col("html"), F.col("_phrases"), v),
            F.when(F.size("_found") >= 2, _verdict("yes", 0.7, F.lit("job_signal_keywords"), F.col("_found"), own)).otherwise(
                _verdict("unclear", 0.2, F.lit("weak_job_signal"), none, none)
            ),
        )
        .otherwise(_verdict("unclear", 0.0, F.lit(""), none, none))
    )
    kept = [c for c in rows.columns if not c.startswith("_") and (c != "body" or "body" not in absent)]
    return compute_once(rows, {"_v": ladder}).select(*kept, "_v.*")


VERDICT_COLUMNS = ["signal", "confidence", "evidence", "evidence_snippets", "evidence_urls"]


def parse_answer(text: Column) -> Column:
    """Verdict struct out of a model's answer; null when it holds no JSON object. A list that is absent is null."""
    data = embedded_json(text)

    def strings(path: str) -> Column:
        return F.try_variant_get(data, path, "array<string>")

    confidence = F.coalesce(F.try_variant_get(data, "$.confidence", "double"), F.lit(0.0))
    parsed = F.struct(
        F.lower(F.coalesce(json_text(data, "$.hiring_signal"), json_text(data, "$.signal"), F.lit(""))).alias("signal"),
        confidence.alias("confidence"),
        F.coalesce(json_text(data, "$.evidence"), F.lit("")).alias("evidence"),
        strings("$.evidence_snippets").alias("evidence_snippets"),
        strings("$.evidence_urls").alias("evidence_urls"),
    )
    return F.when(data.isNotNull(), parsed)


def evidence_gate(verdicts: DataFrame, vocabulary: Vocabulary = DEFAULT_VOCABULARY, stored: int = 6) -> DataFrame:
    """Keep a yes or no only with two excerpts, an address, and the words that back it up.

    Every excerpt may back the verdict; at most ``stored`` of them are passed on.
    """
    none = literal_array([])

    def clean(c: str) -> Column:
        return F.filter(F.transform(F.coalesce(F.col(c), none), strip), lambda s: s != "")

    rows = compute_once(verdicts.withColumn("signal", F.lower("signal")), {"_s": clean("evidence_snippets"), "_u": clean("evidence_urls")})

    def backed(words: list[str]) -> Column:
        return F.exists("_s", lambda s: contains_any(F.lower(s), words))

    decided = F.col("signal").isin("yes", "no")
    thin = (F.size("_s") < 2) | (F.size("_u") == 0)
    vague = F.when(F.col("signal") == "yes", ~backed(vocabulary.evidence)).otherwise(~backed(vocabulary.negative))
    failed = decided & (thin | vague)
    return rows.withColumns(
        {
            "signal": F.when(failed, F.lit("unclear")).otherwise(F.col("signal")),
            "confidence": F.when(failed, F.least("confidence", F.lit(0.2))).otherwise(F.col("confidence")),
            "evidence": F.when(failed & thin, F.lit("insufficient_evidence")).when(failed, F.lit("generic_evidence")).otherwise(F.col("evidence")),
            "evidence_snippets": F.when(failed, none).when(decided, F.slice("_s", 1, stored)).otherwise(F.coalesce("evidence_snippets", none)),
            "evidence_urls": F.when(failed, none).when(decided, F.col("_u")).otherwise(F.coalesce("evidence_urls", none)),
        }
    ).drop("_s", "_u")


def signal_rank(signal: Column) -> Column:
    return F.when(signal == "yes", 2).when(signal == "unclear", 1).otherwise(0)


def best_verdict(verdicts: DataFrame, key: str = "business_id", order: str = "ord") -> DataFrame:
    """Per company the strongest verdict: rank, then confidence, then candidate order."""
    return first_per_key(
        verdicts, [key], [signal_rank(F.col("signal")).desc(), F.coalesce("confidence", F.lit(0.0)).desc(), F.col(order).asc()]
    )


def strongest_wall(walls: DataFrame, key: str = "business_id", order: str = "ord") -> DataFrame:
    """Per company the cookie wall with the highest score, the first one among equals."""
    return first_per_key(walls.where("is_wall"), [key], [F.col("wall_score").desc(), F.col(order).asc()])


def evidence_pairs(found: Column, urls: Column) -> Column:
    """The i-th excerpt with the i-th address, else with the first one."""
    none = F.lit("")
    found, urls = (F.coalesce(c, literal_array([])) for c in (found, urls))
    pairs = F.transform(
        found, lambda s, i: F.struct(s.alias("snippet"), F.coalesce(F.get(urls, i), F.get(urls, F.lit(0)), none).alias("url"))
    )
    return F.filter(pairs, lambda p: (p["snippet"] != "") | (p["url"] != ""))


def evidence_downgrade(df: DataFrame) -> DataFrame:
    """Company status from signal and evidence addresses: a yes needs two own or board pages."""
    urls = F.coalesce(F.col("evidence_urls"), literal_array([]))
    eligible = F.size(F.array_distinct(F.filter(urls, lambda u: is_first_party(u, F.col("domain")) | is_ats_host(u))))
    said = F.lower(F.coalesce("signal", F.lit("")))
    mapped = F.when(said.isin("yes", "no"), said).otherwise(F.lit("uncertain"))
    few = (mapped == "yes") & (F.col("_eligible") < 2)
    conf = F.coalesce("confidence", F.lit(0.0))
    return df.withColumn("_eligible", eligible).withColumns(
        {
            "hiring_status": F.when(few & (F.col("_eligible") == 1), F.lit("maybe")).when(few, F.lit("uncertain")).otherwise(mapped),
            "hiring_confidence": F.when(few & (F.col("_eligible") == 1), F.least(conf, F.lit(0.5)))
            .when(few, F.least(conf, F.lit(0.2)))
            .otherwise(conf),
            "hiring_reasons": F.when(few, literal_array(["insufficient_evidence_urls"])).otherwise(literal_array([])),
        }
    ).drop("_eligible")


def prompt_version(text: str = rules.PROMPT_TEXT) -> Column:
    """First eight hex digits of the prompt's hash, for provenance."""
    return F.left(F.sha2(F.lit(text), 256), F.lit(8))
