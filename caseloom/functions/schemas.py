"""JSON Schema compiled to column expressions over VARIANT.

``errors(value, schema)`` is one expression for a whole document: every rule of the
schema becomes a predicate at its place, arrays are visited by a transform over
their items, and what fails is listed with its path. So a document is checked with no
Python, and arrays of any length need no exploding. A column that is named twice is
computed twice, at every level again, so a value and its readings are bound as the
variable of an aggregate over one item: each is read once, however deep it stands.

Errors are ordered by path (names by code point, items by number, a place before
what is inside it), and at one place by the order of the rules in the schema, so the
first error is the one that a validator sorting by path reports.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a schema that state nothing to check.
NOTES = {"$schema", "$id", "$comment", "title", "description", "default", "examples"}
_ERROR = "array<struct<path: array<struct<item: int, name: string>>, rule: string>>"
_NUMBERED = "array<struct<path: array<struct<item: int, name: string>>, nth: int, rule: string>>"
_FIRST = "struct<place: string, rule: string>"
_NUMBERS = ["TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE"]


_FIELD_RULES = {"required", "properties", "additionalProperties", "minProperties", "maxProperties"}
_ITEM_RULES = {"items", "minItems", "maxItems", "uniqueItems"}


def _let(value: Column, body: Callable[[Column], Column], kind: str = _ERROR) -> Column:
    """``body`` of a value, of type ``kind``, with the value computed once, however often the body names it.

    An aggregate over one item states its type by what it starts with. A transform
    asks its body for it again for every row, and so each body inside that body.
    """
    return F.aggregate(F.array(value), F.lit(None).cast(kind), lambda _, v: body(v))


def _named(schema: dict) -> list[str]:
    """The keys that a schema names."""
    return list(dict.fromkeys([*schema.get("properties", {}), *schema.get("required", [])]))


def _readings(variant: Column, schema: dict, body: Callable[[Column], Column]) -> Column:
    """``body`` of a variant's readings, each null where the value is of another type; fields and items only if a rule looks at them.

    ``at 0``, ``at 1``, ... are the fields that the schema names, null where they are
    absent (a field that holds null is a variant).
    """
    named = _named(schema)
    held = [name for name, rules in (("fields", _FIELD_RULES), ("items", _ITEM_RULES)) if rules & schema.keys()]
    parts = lambda v: F.struct(v.alias("variant"), F.try_variant_get(v, "$", "map<string,variant>").alias("fields"), F.try_variant_get(v, "$", "array<variant>").alias("items"))

    def kinds(p: Column) -> Column:
        kind = F.when(p["fields"].isNotNull(), "OBJECT").when(p["items"].isNotNull(), "ARRAY").otherwise(F.schema_of_variant(p["variant"]))
        return _let(F.struct(p["variant"].alias("variant"), kind.alias("kind"), *[p[name].alias(name) for name in held]), read)

    def read(p: Column) -> Column:
        kind = p["kind"]
        of = lambda test, kind: F.when(test, F.try_variant_get(p["variant"], "$", kind)).alias(kind)
        scalars = [of(kind == "STRING", "string"), of(kind == "BOOLEAN", "boolean"), of(kind.isin(_NUMBERS) | kind.startswith("DECIMAL"), "double")]
        fields = [F.element_at(p["fields"], F.lit(k)).alias(f"at {i}") for i, k in enumerate(named)]
        return _let(F.struct(kind.alias("kind"), *scalars, *[p[name].alias(name) for name in held], *fields), body)

    return _let(variant, lambda v: _let(parts(v), kinds))


class _Value:
    """What is read of a variant, as ``_readings`` gives it."""

    def __init__(self, held: Column, schema: dict):
        kind = held["kind"]
        self.is_null = kind == "VOID"
        self.is_string, self.is_boolean, self.is_object, self.is_array = (kind == k for k in ("STRING", "BOOLEAN", "OBJECT", "ARRAY"))
        self.is_number = held["double"].isNotNull()
        self.string, self.boolean, self.number = held["string"], held["boolean"], held["double"]
        self.fields, self.items = held["fields"], held["items"]
        self.at = {k: held[f"at {i}"] for i, k in enumerate(_named(schema))}

    def is_type(self, name: str) -> Column:
        if name == "integer":
            return self.is_number & (self.number == F.floor(self.number))
        return {"null": self.is_null, "string": self.is_string, "boolean": self.is_boolean, "number": self.is_number, "object": self.is_object, "array": self.is_array}[name]

    def equals(self, constant: Any) -> Column:
        if constant is None:
            return self.is_null
        if isinstance(constant, bool):
            return F.coalesce(self.boolean == F.lit(constant), F.lit(False))
        if isinstance(constant, str):
            return F.coalesce(self.string == F.lit(constant), F.lit(False))
        if isinstance(constant, int | float):
            return F.coalesce(self.number == F.lit(float(constant)), F.lit(False))
        raise ValueError(f"only plain constants can be compared: {json.dumps(constant)}")


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def _rule(value: _Value, word: str, given: Any, schema: dict) -> Column | None:
    """Whether a value breaks a rule that looks at the value alone; null counts as no."""
    as_list = given if isinstance(given, list) else [given]
    match word:
        case "type":
            return ~_any([value.is_type(t) for t in as_list])
        case "enum":
            return ~_any([value.equals(c) for c in given])
        case "const":
            return ~value.equals(given)
        case "minLength":
            return F.char_length(value.string) < given
        case "maxLength":
            return F.char_length(value.string) > given
        case "pattern":
            return ~value.string.rlike(given)
        case "minimum":
            return value.number < given
        case "maximum":
            return value.number > given
        case "exclusiveMinimum":
            return value.number <= given
        case "exclusiveMaximum":
            return value.number >= given
        case "minItems":
            return F.size(value.items) < given
        case "maxItems":
            return F.size(value.items) > given
        case "uniqueItems":
            texts = F.transform(value.items, lambda x: F.to_json(x))
            return F.lit(bool(given)) & (F.size(F.array_distinct(texts)) < F.size(texts))
        case "minProperties":
            return F.size(value.fields) < given
        case "maxProperties":
            return F.size(value.fields) > given
        case "additionalProperties" if given is False:
            known = [value.at[k].isNotNull().cast("int") for k in schema.get("properties", {})]
            return F.size(value.fields) > reduce(lambda a, b: a + b, known, F.lit(0))  # keys differ
    return None


def _found(variant: Column, schema: dict | bool, path: Column) -> Column:
    """Errors of a value at a path, as an array in the order of the schema's rules."""
    none = F.array().cast(_ERROR)
    if isinstance(schema, bool):
        return none if schema else F.array(F.struct(path.alias("path"), F.lit("false").alias("rule")))
    return _readings(variant, schema, lambda held: _broken(_Value(held, schema), schema, path))


def _broken(value: _Value, schema: dict, path: Column) -> Column:
    none = F.array().cast(_ERROR)
    parts: list[Column] = []
    fails = lambda test, rule: F.when(F.coalesce(test, F.lit(False)), F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))).otherwise(none)
    step = lambda item, name: F.concat(path, F.array(F.struct(item.cast("int").alias("item"), name.alias("name"))))
    named = lambda name: step(F.lit(-1), name)
    for word, given in schema.items():
        if word in NOTES:
            continue
        if word == "required":
            parts += [fails(value.is_object & value.at[k].isNull(), "required") for k in given]
        elif word == "properties":
            parts += [F.when(value.at[k].isNotNull(), _found(value.at[k], sub, named(F.lit(k)))).otherwise(none) for k, sub in given.items()]
        elif word == "items":
            each = F.transform(value.items, lambda x, i: _found(x, given, step(i, F.lit(""))))
            parts.append(F.coalesce(F.flatten(each), none))
        elif word == "additionalProperties" and isinstance(given, dict):
            known = F.array(*[F.lit(k) for k in schema.get("properties", {})]).cast("array<string>")
            others = F.map_entries(F.map_filter(value.fields, lambda k, _: ~F.array_contains(known, k)))
            parts.append(F.coalesce(F.flatten(F.transform(others, lambda e: _found(e["value"], given, named(e["key"])))), none))
        elif (test := _rule(value, word, given, schema)) is not None:
            parts.append(fails(test, word))
        elif not (word == "additionalProperties" and given is True):
            raise ValueError(f"a schema with {word!r} can't be compiled")
    return F.concat(*parts) if parts else none


def errors(variant: Column, schema: dict | bool) -> Column:
    """All errors of a document: an array of (path, nth, rule) by path, then by the order of rules; null for a null document."""
    root = F.array().cast("array<struct<item: int, name: string>>")

    def of(v: Column) -> Column:
        numbered = F.transform(_found(v, schema, root), lambda e, i: F.struct(e["path"].alias("path"), i.alias("nth"), e["rule"].alias("rule")))
        return F.when(v.isNotNull(), F.array_sort(numbered))

    return _let(variant, of, _NUMBERED)


def path_text(path: Column) -> Column:
    """``a.0.b``, or ``<root>``."""
    parts = F.transform(path, lambda p: F.when(p["item"] >= 0, p["item"].cast("string")).otherwise(p["name"]))
    return F.when(F.size(path) == 0, "<root>").otherwise(F.array_join(parts, "."))


def first_error(text: Column, schema: dict | bool) -> Column:
    """(place, rule) of the first error of a JSON text; rule ``json`` at the root where it can't be parsed (or is null), null where all is well."""
    unread = F.struct(F.lit("<root>").alias("place"), F.lit("json").alias("rule"))
    named = lambda e: F.when(e.isNotNull(), F.struct(path_text(e["path"]).alias("place"), e["rule"].alias("rule")))
    return _let(F.try_parse_json(text), lambda v: F.when(v.isNull(), unread).otherwise(_let(F.get(errors(v, schema), F.lit(0)), named, _FIRST)), _FIRST)
