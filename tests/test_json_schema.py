"""The compiled schema against documents that break every keyword."""

import json

import pytest

from hireatlas.operators import contract, json_schema as J

SCHEMA = {
    "type": "object",
    "title": "sample",
    "required": ["id", "when"],
    "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 1, "maximum": 10},
        "when": {"type": ["string", "null"], "pattern": "^[0-9]{4}$"},
        "name": {"type": "string", "minLength": 2, "maxLength": 4},
        "rate": {"type": "number", "exclusiveMinimum": 0, "exclusiveMaximum": 1},
        "kind": {"enum": ["a", "b", 3, None, True]},
        "fixed": {"const": "x"},
        "odd 'name'": {"type": "boolean"},
        "list": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "array", "items": {"type": "object", "required": ["u"], "properties": {"u": {"type": "string"}}}}},
    },
}
CASES = [
    ({"id": 1, "when": "2024"}, []),
    ({"id": 2.0, "when": None, "name": "ab", "rate": 0.5, "kind": 3, "fixed": "x", "odd 'name'": True, "list": [[]]}, []),
    ({"id": 1.5, "when": 5}, ["wrong type id: number", "wrong type when: integer"]),
    ({"id": "1"}, ["missing when", "wrong type id: string"]),
    ({"id": 0, "when": "x"}, ["minimum 1 id: 0.0", "pattern when: x"]),
    ({"id": 11, "when": "2024", "more": 1, "and": 2}, ["unexpected and", "unexpected more", "maximum 10 id: 11.0"]),
    ({"id": 1, "when": None, "name": "é"}, ["minLength 2 name: 1"]),
    ({"id": 1, "when": None, "name": "abcde", "rate": 0}, ["maxLength 4 name: 5", "exclusiveMinimum 0 rate: 0.0"]),
    ({"id": 1, "when": None, "rate": 1, "kind": "c", "fixed": "y"}, ["exclusiveMaximum 1 rate: 1.0", "invalid kind c", "invalid fixed y"]),
    ({"id": 1, "when": None, "kind": 4, "odd 'name'": 0}, ["invalid kind 4", "wrong type odd 'name': integer"]),
    ({"id": 1, "when": None, "kind": None}, []),
    ({"id": 1, "when": None, "list": []}, ["minItems 1 list: 0"]),
    ({"id": 1, "when": None, "list": [[{"u": 1}, {}], [{"u": "x"}, 3], "y"]}, ["maxItems 2 list: 3", "wrong type list[0][0].u: integer", "missing list[0][1].u", "wrong type list[1][1]: integer", "wrong type list[2]: string"]),
    ([1], ["wrong type document: array"]),
    (7, ["wrong type document: integer"]),
]


def test_every_keyword(spark):
    rows = [(i, json.dumps(doc)) for i, (doc, _) in enumerate(CASES)] + [(100, "{broken"), (101, None), (102, "")]
    df = spark.createDataFrame(rows, "id int, doc string")
    found: dict[int, list[str]] = {}
    for r in J.schema_violations(df, SCHEMA, "id", "doc").collect():
        found.setdefault(r.id, []).append(r.violation)
    for i, (doc, want) in enumerate(CASES):
        assert sorted(found.get(i, [])) == sorted(want), doc
    assert [found[i] for i in (100, 101, 102)] == [["not a JSON document"]] * 3


def test_unknown_keywords_are_refused(spark):
    df = spark.createDataFrame([(1, "{}")], "id int, doc string")
    for schema in ({"anyOf": []}, {"properties": {"a": {"format": "date"}}}, {"additionalProperties": {"type": "string"}}):
        with pytest.raises(ValueError):
            J.schema_violations(df, schema, "id", "doc")


def test_the_package_schema_names_its_parts():
    required = contract.PACKAGE_SCHEMA["required"]
    assert {"status", "hiring", "safety", "notes"} <= set(required) and "error" not in required
    assert contract.PACKAGE_SCHEMA["properties"]["safety"]["properties"]["cookie_wall"]["properties"]["threshold"]["required"] == ["hits_min", "score_min", "text_max_len", "hits_hard"]
