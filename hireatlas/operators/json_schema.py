"""A JSON schema compiled into one column expression that lists every violation of a document.

The document is a variant, read in place: objects by path, arrays by a transform over their items, so nothing is exploded or shuffled. Known
keywords: type, enum, const, required, properties, additionalProperties (false), items, minItems, maxItems, minimum, maximum,
exclusiveMinimum, exclusiveMaximum, minLength, maxLength, pattern; another one is refused when the schema is compiled, so no rule is
dropped in silence. A keyword speaks about values of its own type only; a missing property is reported by ``required`` of its parent.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from hireatlas.functions.text import literal_array
from hireatlas.operators.once import compute_once

_NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples"}
_KNOWN = {
    "type", "enum", "const", "required", "properties", "additionalProperties", "items", "minItems", "maxItems", "minimum", "maximum", "exclusiveMinimum",
    "exclusiveMaximum", "minLength", "maxLength", "pattern",
}


def _kind(value: Column) -> Column:
    """JSON type of a variant; null for an absent one."""
    name = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(value.isNull(), F.lit(None))
        .when(name == "VOID", "null")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(F.startswith(name, F.lit("ARRAY")), "array")
        .when(F.startswith(name, F.lit("OBJECT")), "object")
        .when((name == "BIGINT") | (number == F.floor(number)), "integer")
        .otherwise("number")
    )


def _child(path: Column, name: str) -> Column:
    return F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit(f".{name}")))


def _member(value: Column, name: str) -> Column:
    if "'" in name and '"' in name:
        raise ValueError(f"a property name with both kinds of quotes cannot be read: {name}")
    quote = '"' if "'" in name else "'"
    return F.try_variant_get(value, f"$[{quote}{name}{quote}]", "variant")


def violations_of(value: Column, schema: dict, path: Column) -> Column:
    """``array<string>``: what the value, which lies at the path, breaks of the schema.

    The value and its type become a variable of a lambda, so the expression grows with the schema and not with its depth.
    """
    unknown = set(schema) - _KNOWN - _NOTES
    if unknown or schema.get("additionalProperties") not in (None, True, False):
        raise ValueError(f"schema keywords that are not supported: {sorted(unknown) or ['additionalProperties with a schema']}")
    typed = F.transform(F.array(value), lambda v: F.struct(v.alias("v"), _kind(v).alias("kind")))
    return F.flatten(F.transform(typed, lambda node: _checks(node["v"], node["kind"], schema, path)))


def _checks(value: Column, kind: Column, schema: dict, path: Column) -> Column:
    text = F.try_variant_get(value, "$", "string")
    number = F.when(kind.isin("integer", "number"), F.try_variant_get(value, "$", "double"))
    length = F.when(kind == "string", F.length(text))
    items = F.when(kind == "array", F.try_variant_get(value, "$", "array<variant>"))
    # The root has no path of its own.
    at = F.when(path == "", F.lit("document")).otherwise(path)
    found: list[Column] = []

    def unless(fine: Column, *words) -> None:
        parts = [w if isinstance(w, Column) else F.lit(w) for w in words]
        found.append(F.when(~fine, F.concat(*parts)))

    if "type" in schema:
        wanted = [schema["type"]] if isinstance(schema["type"], str) else list(schema["type"])
        fits = kind.isin([*wanted, "integer"] if "number" in wanted else wanted)
        unless(fits, "wrong type ", at, ": ", kind)
    allowed = schema.get("enum", [schema["const"]] if "const" in schema else None)
    if allowed is not None:
        texts = [v for v in allowed if isinstance(v, str)]
        others = [json.dumps(v) for v in allowed if not isinstance(v, str)]
        # A scalar's text, with the null of JSON spelled out.
        plain = F.when(kind == "null", "null").otherwise(text)
        same = F.when(kind == "string", plain.isin(texts) if texts else F.lit(False)).otherwise(plain.isin(others) if others else F.lit(False))
        unless(F.when(kind.isNotNull(), F.coalesce(same, F.lit(False))), "invalid ", at, " ", F.coalesce(plain, kind))
    for word, measure, fine in (
        ("minimum", number, lambda a, b: a >= b), ("maximum", number, lambda a, b: a <= b), ("exclusiveMinimum", number, lambda a, b: a > b), ("exclusiveMaximum", number, lambda a, b: a < b),
        ("minLength", length, lambda a, b: a >= b), ("maxLength", length, lambda a, b: a <= b),
        ("minItems", F.when(items.isNotNull(), F.size(items)), lambda a, b: a >= b), ("maxItems", F.when(items.isNotNull(), F.size(items)), lambda a, b: a <= b),
    ):
        if word in schema:
            unless(fine(measure, F.lit(schema[word])), f"{word} {schema[word]} ", at, ": ", measure.cast("string"))
    if "pattern" in schema:
        unless(F.when(kind == "string", text.rlike(schema["pattern"])), "pattern ", at, ": ", text)
    for name in schema.get("required", []):
        unless(F.when(kind == "object", _member(value, name).isNotNull()), "missing ", _child(path, name))
    lists = [F.array_compact(F.array(*found))] if found else []
    if schema.get("additionalProperties") is False:
        names = F.map_keys(F.when(kind == "object", F.try_variant_get(value, "$", "map<string,variant>")))
        extra = F.array_sort(F.array_except(names, literal_array(schema.get("properties", {}))))
        lists.append(F.transform(extra, lambda n: F.concat(F.lit("unexpected "), F.when(path == "", n).otherwise(F.concat(path, F.lit("."), n)))))
    for name, own in schema.get("properties", {}).items():
        lists.append(violations_of(F.when(kind == "object", _member(value, name)), own, _child(path, name)))
    if "items" in schema:
        each = F.transform(items, lambda v, i: violations_of(v, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))))
        lists.append(F.flatten(each))
    none = literal_array([])
    return F.concat(none, *(F.coalesce(x, none) for x in lists))


def schema_violations(df: DataFrame, schema: dict, key: str, document: str) -> DataFrame:
    """``key, violation``: one row per violation of the JSON text in ``document``; broken text and null are no JSON document."""
    rows = compute_once(df, {"_v": F.try_parse_json(document)}).select(key, "_v")
    found = F.when(F.col("_v").isNull(), literal_array(["not a JSON document"])).otherwise(violations_of(F.col("_v"), schema, F.lit("")))
    return rows.select(key, F.explode_outer(found).alias("violation")).where("violation IS NOT NULL")
