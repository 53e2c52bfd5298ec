"""Compiled schemas against a plain validator of the same rules."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from caseloom.functions import schemas

TEXT = {"type": "string"}
CLOSED = lambda required, **properties: {"type": "object", "additionalProperties": False, "required": required, "properties": properties}
FILES = {"type": "array", "minItems": 1, "items": CLOSED(["path", "content"], path=TEXT, content=TEXT)}
#: Documents of the shapes that pipelines exchange: bundles of files, a decision, a report, ideas.
SHAPES = {
    "files": CLOSED(["manifest", "files"], manifest={"type": "array", "items": CLOSED(["path", "purpose"], path=TEXT, purpose=TEXT)}, files=FILES),
    "tests": CLOSED(["requirement_map", "files"], requirement_map={"type": "array", "minItems": 1, "items": CLOSED(["requirement_id", "requirement_type", "test_files"], requirement_id=TEXT, requirement_type={"type": "string", "enum": ["functional", "security"]}, test_files={"type": "array", "items": TEXT})}, files=FILES),
    "decision": CLOSED(["retain_case", "score"], retain_case={"type": "boolean"}, score={"type": "number"}, artifact={"type": "string", "enum": ["none", "mutants"]}),
    "report": CLOSED(["status", "findings"], status={"enum": ["pass", "warning", "fail", None, 3]}, findings={"type": "array", "maxItems": 2, "uniqueItems": True, "items": {"type": ["string", "null"], "pattern": "^[a-c]", "maxLength": 3}}),
    "ideas": {"type": "object", "minProperties": 1, "properties": {"n": {"type": "integer", "minimum": 0, "exclusiveMaximum": 5}}, "additionalProperties": {"type": "array", "items": {"const": True}}},
}


def plain(value, schema, path=()):
    """Errors in the order of the schema's words."""
    number = isinstance(value, int | float) and not isinstance(value, bool)
    kinds = {"string": isinstance(value, str), "boolean": isinstance(value, bool), "null": value is None, "number": number, "integer": number and value == int(value), "object": isinstance(value, dict), "array": isinstance(value, list)}
    same = lambda a, b: a == b and isinstance(a, bool) == isinstance(b, bool)
    for word, given in schema.items():
        fails = {
            "type": lambda: not any(kinds[t] for t in (given if isinstance(given, list) else [given])), "enum": lambda: not any(same(value, c) for c in given), "const": lambda: not same(value, given),
            "minItems": lambda: kinds["array"] and len(value) < given, "maxItems": lambda: kinds["array"] and len(value) > given, "uniqueItems": lambda: kinds["array"] and len({json.dumps(x) for x in value}) < len(value),
            "pattern": lambda: kinds["string"] and not re.search(given, value), "maxLength": lambda: kinds["string"] and len(value) > given, "minProperties": lambda: kinds["object"] and len(value) < given,
            "minimum": lambda: number and value < given, "exclusiveMaximum": lambda: number and value >= given,
            "additionalProperties": lambda: given is False and kinds["object"] and set(value) - set(schema["properties"]),
        }.get(word, lambda: False)
        if fails():
            yield path, word
        if word == "required" and kinds["object"]:
            yield from ((path, "required") for k in given if k not in value)
        if word == "properties" and kinds["object"]:
            for k, sub in given.items():
                if k in value:
                    yield from plain(value[k], sub, (*path, k))
        if word == "items" and kinds["array"]:
            for i, x in enumerate(value):
                yield from plain(x, given, (*path, i))
        if word == "additionalProperties" and isinstance(given, dict) and kinds["object"]:
            for k in value:
                if k not in schema.get("properties", {}):
                    yield from plain(value[k], given, (*path, k))


def made(r, schema, depth=0):
    """A document that mostly fits."""
    if r.random() < 0.08:
        return r.choice([None, True, 3, -1, 2.5, "x", "abc", [], {}, ["a", "a"], {"path": 1}, 7])
    if "enum" in schema:
        return r.choice(schema["enum"])
    kind = schema.get("type", "string")
    kind = r.choice(kind) if isinstance(kind, list) else kind
    if kind == "object":
        out = {k: made(r, s, depth + 1) for k, s in schema.get("properties", {}).items() if r.random() < 0.93}
        if r.random() < 0.1:
            out["extra"] = r.choice([[True, False], "y", [True]])
        return dict(r.sample(sorted(out.items()), len(out)))
    if kind == "array":
        return [made(r, schema["items"], depth + 1) for _ in range(r.randrange(4))]
    return {"string": r.choice(["a", "b", "cz", "zz", "abcd"]), "boolean": True, "number": 1.5, "integer": r.randrange(-1, 7), "null": None}[kind]


@pytest.mark.parametrize("name", sorted(SHAPES))
def test_errors_equal_a_plain_validator(spark, name):
    r, schema = random.Random(name), SHAPES[name]
    docs = [made(r, schema) for _ in range(150)] + [[], "text", 3, None, {}]
    data = [(i, json.dumps(d)) for i, d in enumerate(docs)]
    df = spark.createDataFrame(data, "id int, text string")
    got = {x["id"]: x for x in df.select("id", schemas.errors(F.parse_json("text"), schema).alias("e"), schemas.first_error(F.col("text"), schema).alias("f")).collect()}
    faulty = 0
    for i, doc in enumerate(docs):
        want = sorted(plain(doc, schema), key=lambda e: [(-1, p) if isinstance(p, str) else (p, "") for p in e[0]])
        assert [(tuple(p["item"] if p["item"] >= 0 else p["name"] for p in e["path"]), e["rule"]) for e in got[i]["e"]] == want, doc
        assert (tuple(got[i]["f"]) if got[i]["f"] else None) == ((".".join(map(str, want[0][0])) or "<root>", want[0][1]) if want else None)
        faulty += bool(want)
    assert 20 < faulty < 150


def test_first_error_of_texts_that_are_no_json(spark):
    df = spark.createDataFrame([("{",), (None,), ("",), ('{"score": 1, "retain_case": true}',)], "text string")
    got = [x["e"] and tuple(x["e"]) for x in df.select(schemas.first_error(F.col("text"), SHAPES["decision"]).alias("e")).collect()]
    assert got == [("<root>", "json")] * 3 + [None]


def test_what_cannot_be_compiled_is_said():
    with pytest.raises(ValueError, match="allOf"):
        schemas.errors(F.parse_json(F.lit("1")), {"allOf": []})


def nested(depth):
    return CLOSED(["a"], a={"type": "integer", "minimum": 0} if depth == 1 else nested(depth - 1))


def test_each_value_is_read_once_however_deep(spark):
    """What is computed for a level is what that level adds: a named column was computed again by every rule that names it, at every level inside."""
    read = {}
    for depth in (2, 3, 4, 5):
        df = spark.range(1).select(schemas.errors(F.try_parse_json(F.col("id").cast("string")), nested(depth)).alias("e"))
        read[depth] = df._jdf.queryExecution().analyzed().toString().count("try_variant_get(")
    assert len({read[d + 1] - read[d] for d in (2, 3, 4)}) == 1 and read[5] < 60
    doc = '{"a": {"a": {"a": {"a": {"a": -1}}}}}'
    assert tuple(spark.createDataFrame([(doc,)], "text string").select(F.inline(F.array(schemas.first_error(F.col("text"), nested(5))))).first()) == ("a.a.a.a.a", "minimum")
