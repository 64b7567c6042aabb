"""Lenient parsing: timestamps, booleans, numbers, lists and JSON inside free text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hireatlas.functions.text import strip
from hireatlas.rules import BOOL_FALSE, BOOL_TRUE

_TIME_FORMATS = ["yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "dd MMM yyyy"]


def posted_ts(c: Column | str) -> Column:
    """Timestamp from ISO text, a few plain layouts or epoch milliseconds; bad text gives null."""
    text = strip(c)
    epoch = F.when(text.rlike(r"^\d{12,13}$"), F.timestamp_millis(text.try_cast("long")))
    # The all-digits text must not reach the plain cast, which would read a year out of it.
    plain = F.when(~text.rlike(r"^\d+$"), text.try_cast("timestamp"))
    others = [F.try_to_timestamp(text, F.lit(f)) for f in _TIME_FORMATS]
    return F.coalesce(epoch, plain, *others)


def parse_bool(c: Column | str) -> Column:
    word = F.lower(strip(c))
    return F.when(word.isin(BOOL_TRUE), F.lit(True)).when(word.isin(BOOL_FALSE), F.lit(False))


def parse_number(c: Column | str) -> Column:
    """Double, with NaN turned into null so that comparisons drop it as they drop a missing value."""
    value = strip(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def parse_list(c: Column | str) -> Column:
    """Array from JSON text or ``;`` text; blank gives an empty array, broken JSON gives null."""
    column = F.col(c) if isinstance(c, str) else c
    text = strip(column)
    pieces = F.filter(F.transform(F.split(text, ";"), strip), lambda p: p != "")
    return (
        F.when(text.isNull() | (text == ""), F.array().cast("array<string>"))
        .when(F.startswith(text, F.lit("[")), F.try_parse_json(text).try_cast("array<string>"))
        .otherwise(pieces)
    )


def embedded_json(c: Column | str) -> Column:
    """The JSON value of the whole text, else of its part from the first ``{`` to the last ``}``."""
    column = F.col(c) if isinstance(c, str) else c
    inner = F.nullif(F.regexp_extract(column, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(F.try_parse_json(column), F.try_parse_json(inner))


def json_text(variant: Column, path: str) -> Column:
    return F.try_variant_get(variant, path, "string")
