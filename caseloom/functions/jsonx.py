"""Tolerant JSON: built-in parsing first, Arrow batches only for rows that need a scan."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = r"(?s)^\s*```(?:json)?\s*\n(.*?)\n?\s*```\s*$"


def unfenced(text: Column) -> Column:
    """The inside of a text that is one fenced block as a whole, else the text."""
    return F.when(F.regexp_like(text, F.lit(FENCE)), F.regexp_extract(text, FENCE, 1)).otherwise(text)


def first_key(text: Column, paths: list[str]) -> Column:
    """The first of several paths that has a non-empty value."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(text, p)), F.lit("")) for p in paths])


def _parsed(text: str) -> object:
    try:
        return json.loads(text)
    except (ValueError, RecursionError):  # the latter where brackets nest too deep
        return None


#: A fenced block around an object, to its nearest and to its farthest end.
_FENCED = re.compile(r"```(?:json)?\s*(\{.*?\})\s*```", re.IGNORECASE | re.DOTALL)
_WIDELY_FENCED = re.compile(r"```(?:json)?\s*(\{.*\})\s*```", re.DOTALL)


def object_in(text: str | None) -> str | None:
    """The text itself if it is an object, else the first fenced one, else the first that starts at any brace."""
    if text is None:
        return None
    fence = _FENCED.search(text)
    for whole in (text.strip(), fence and fence[1]):
        if whole and isinstance(_parsed(whole), dict):
            return whole
    decoder, at, last = json.JSONDecoder(), text.find("{"), text.rfind("}")
    while 0 <= at < last:  # an object that nothing closes is none
        try:
            return text[at : decoder.raw_decode(text, at)[1]]
        except (ValueError, RecursionError):
            at = text.find("{", at + 1)
    return None


def _embedded(texts: pd.Series) -> pd.Series:
    return texts.map(object_in)


def embedded_object(text: Column) -> Column:
    """The first JSON object inside a text; braces in strings do not count. Texts that parse whole stay with the built-in parser."""
    whole = F.try_parse_json(text)
    is_object = F.coalesce(F.startswith(F.schema_of_variant(whole), F.lit("OBJECT")), F.lit(False))
    # a UDF runs before the CASE, so rows that need none hand it a null
    found = F.pandas_udf(_embedded, "string")(F.when(~is_object, text))
    return F.when(is_object, text).otherwise(found)


def closed(text: str) -> str | None:
    """Text with the closers that it lacks, in the right order; null if it lacks none, ends inside a string or closes what is not open."""
    lacking: list[str] = []
    at, in_string = 0, False
    while at < len(text):
        char = text[at]
        if in_string and char == "\\":
            at += 1
        elif char == '"':
            in_string = not in_string
        elif not in_string and char in "{[":
            lacking.append({"{": "}", "[": "]"}[char])
        elif not in_string and char in "}]" and (not lacking or lacking.pop() != char):
            return None
        at += 1
    return None if in_string or not lacking else text + "".join(reversed(lacking))


def _balanced(text: str) -> str | None:
    """From the first brace to where as many are closed as were opened; braces in strings count too."""
    depth = 0
    for brace in re.finditer(r"[{}]", text[(start := text.find("{")) :] if "{" in text else ""):
        depth += 1 if brace[0] == "{" else -1
        if depth == 0:
            return text[start : start + brace.end()]
    return None


def repaired(text: str | None) -> str | None:
    """The text if it is an object; where it is no JSON the widely fenced or balanced part, and where there is none the text closed. Null if that is no object."""
    if text is None or isinstance(_parsed(text), dict):
        return text
    if _parsed(text) is not None or text.strip() == "null":
        return None
    fence = _WIDELY_FENCED.search(text)
    part = fence[1] if fence else _balanced(text)
    made = part if part is not None else closed(text.strip())
    return made if made is not None and isinstance(_parsed(made), dict) else None


def _repaired(texts: pd.Series) -> pd.Series:
    return texts.map(repaired)


def repaired_object(text: Column) -> Column:
    """An object from a text that is not quite one (see ``repaired``): unlike ``embedded_object`` it does not look into strings, and it closes what a cut-off text leaves open."""
    is_object = F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(text)), F.lit("OBJECT")), F.lit(False))
    found = F.pandas_udf(_repaired, "string")(F.when(~is_object, text))
    return F.when(is_object, text).otherwise(found)
