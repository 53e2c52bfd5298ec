"""Text expressions over evaluator output, public files and paths. All stay in built-in Spark functions."""

from __future__ import annotations

import operator
import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

#: The marker line of an evaluator, and the pseudo test that reports a broken set-up.
FAIL_MARKER = r"\[TEST\]\s+FAIL:\s+([\w-]+)"
PASS_OR_FAIL_MARKER = r"\[TEST\]\s+(?:PASS|FAIL):\s+([\w-]+)"
SKIP_MARKER = r"\[TEST\]\s+SKIP:\s+([\w-]+)"
SETUP = "SETUP"
#: Identifiers that must not be public, the first in any case, the second as written, and file names that reveal them.
WEAKNESS_TOKEN = r"(?i)\bCWE[-_]?\d+\b"
REQUIREMENT_TOKEN = r"\bSR-?\d+\b"
REVEALING_NAME = r"(?i)security[_-]?spec|cwe|threat[_-]?model|security[_-]?requirement"
LEAKS_SHOWN = 8
#: How an evaluator reports a broken set-up and a crash.
SETUP_FAILURE = "[TEST] FAIL: SETUP"
CRASH = "Traceback (most recent call last)"
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\u0085\u2028\u2029]"


def markers(text: Column, pattern: str) -> Column:
    """Distinct marker names in order of appearance, without the set-up marker."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
    return F.array_remove(F.array_distinct(found), SETUP)


def leaked_tokens(text: Column, patterns: tuple[str, ...] = (WEAKNESS_TOKEN, REQUIREMENT_TOKEN)) -> Column:
    """The first few distinct tokens, sorted, that any pattern finds."""
    found = F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0)) for p in patterns])
    return F.slice(F.array_sort(F.array_distinct(found)), 1, LEAKS_SHOWN)


def scrubbed(text: Column, patterns: tuple[str, ...] = (WEAKNESS_TOKEN, REQUIREMENT_TOKEN)) -> Column:
    """Text without what any pattern finds: tokens then go in any case, with the mark and the white space behind each; runs of white space shrink. A text without a find stays as it is."""
    every = "(?i)(?:" + "|".join(p.removeprefix("(?i)") for p in patterns) + r")[:,]?\s*"
    without = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, every, ""), r"\s{2,}", " "), r"^\s+|\s+$", "")
    found = F.lit(False)
    for p in patterns:
        found = found | F.regexp_like(text, F.lit(p))
    return F.when(found, without).otherwise(text)


def removed_tokens(text: Column, patterns: tuple[str, ...] = (WEAKNESS_TOKEN, REQUIREMENT_TOKEN)) -> Column:
    """What ``scrubbed`` found, pattern by pattern in order of appearance."""
    return F.concat(*[F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(p), F.lit(0)) for p in patterns])


def scrubbed_value(value: Column, kind: DataType, leave: tuple[str, ...] = ()) -> Column:
    """A value of any nested type with every string in it scrubbed; struct fields named in ``leave`` and map keys stay."""
    if isinstance(kind, StringType):
        return scrubbed(value)
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: scrubbed_value(x, kind.elementType, leave))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, x: scrubbed_value(x, kind.valueType, leave))
    if isinstance(kind, StructType):
        fields = [(value[f.name] if f.name in leave else scrubbed_value(value[f.name], f.dataType, leave)).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def slug(text: Column, fallback: str) -> Column:
    made = F.regexp_replace(F.lower(F.trim(text)), "[^A-Za-z0-9_-]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(made, "^_+|_+$", ""), F.lit("")), F.lit(fallback))


def masked(text: Column) -> Column:
    """Text with absolute paths hidden."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"/[^\s:]+", "<path>")


def failure_signature(failure_class: Column, golden: Column, vulnerable: Column) -> Column:
    """A digest that equal failures share, or null where nothing failed.

    Parts: the class; of the golden and then of the vulnerable run (structs of
    status, returncode, stdout, stderr) status, exit code and sorted failing
    checks; the golden run's output head and error tail and the vulnerable one's
    output head, cut first and then masked.
    """
    out = lambda r: F.coalesce(r["stdout"], F.lit(""))
    said = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    failing = lambda r: F.array_join(F.array_sort(markers(r["stdout"], FAIL_MARKER)), ",")
    runs = [part for r in (golden, vulnerable) for part in (said(r["status"]), said(r["returncode"]), failing(r))]
    texts = [masked(F.left(out(golden), F.lit(500))), masked(F.right(F.coalesce(golden["stderr"], F.lit("")), F.lit(500))), masked(F.left(out(vulnerable), F.lit(500)))]
    return F.when(failure_class.isNotNull(), F.sha2(F.concat_ws("|", failure_class, *runs, *texts), 256))


def degenerate(text: Column, tail: int = 4000) -> Column:
    """Whether the tail loops: one character 500 times running, or 40 lines and more of which under 15 % differ."""
    last = F.right(text, F.lit(tail))
    return F.coalesce(F.regexp_like(last, F.lit(r"(?s)(.)\1{499}")) | few_distinct_lines(last), F.lit(False))


def lines_of(text: Column) -> Column:
    """Lines that hold more than white space, as they stand."""
    return F.filter(F.split(text, LINE_END), lambda x: F.regexp_like(x, F.lit(r"\S")))


def few_distinct_lines(text: Column, least: int = 40, share: float = 0.15) -> Column:
    lines = lines_of(text)
    return (F.size(lines) >= least) & (F.size(F.array_distinct(lines)) < F.size(lines) * F.lit(share))


NO_DIAGNOSTIC = "no actionable evaluator output was emitted"


def diagnostic_line(*runs: Column) -> Column:
    """The line that explains a failure, of the first run (struct of stdout, stderr) that has one.

    The last error line after a crash, else the first error line, else the first
    output line that starts with a set-up failure, else with a failed check.
    """

    def of(run: Column) -> Column:
        stripped = lambda c: F.transform(lines_of(F.coalesce(c, F.lit(""))), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
        errors, out = stripped(run["stderr"]), stripped(run["stdout"])
        starting = lambda mark: F.get(F.filter(out, lambda x: x.startswith(mark)), F.lit(0))
        error = F.when(F.contains(run["stderr"], F.lit(CRASH)), F.try_element_at(errors, F.lit(-1))).otherwise(F.get(errors, F.lit(0)))
        return F.coalesce(error, starting(SETUP_FAILURE), starting("[TEST] FAIL:"))

    return F.left(F.coalesce(*map(of, runs), F.lit(NO_DIAGNOSTIC)), F.lit(500))


def last_lines(text: Column, n: int = 20) -> Column:
    lines = F.split(text, "\n")
    return F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n))


def visible_text(html: Column) -> Column:
    """Page text without comments, scripts, styles and tags, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?s)<!--.*?-->", " "), r"(?is)<(?:script|style)\b.*?</(?:script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"[ \t\r\n]+", " "))


def safe_path(path: Column) -> Column:
    """Relative, not empty, and without a step upwards."""
    return F.coalesce((path != "") & (path != ".") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), ".."), F.lit(False))


def normal_path(path: Column) -> Column:
    """Trimmed, with forward slashes and without empty or ``.`` steps; null if it leaves its root."""
    slashed = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    steps = F.filter(F.split(slashed, "/"), lambda s: (s != "") & (s != "."))
    inside = ~slashed.startswith("/") & ~F.array_contains(steps, "..") & (F.size(steps) > 0)
    return F.when(inside, F.array_join(steps, "/"))


def path_allowed(path: Column, allowed: Column) -> Column:
    """Named exactly, or below an allowed folder."""
    return F.exists(allowed, lambda a: (path == a) | path.startswith(F.concat(F.rtrim(a, F.lit("/")), F.lit("/"))))


def first_rule(text: Column, needles: list[tuple[str, str]], otherwise: str) -> Column:
    """The value of the first needle that the text holds."""
    chain = None
    for needle, value in needles:
        hit = F.contains(F.lower(text), F.lit(needle))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return F.lit(otherwise) if chain is None else chain.otherwise(otherwise)


def near_each_other(text: Column, one: str, other: str, within: int) -> Column:
    """Whether two words stand within so many characters of each other, in either order; letters, digits and ``_`` of ASCII make words."""
    part, edge = "[A-Za-z0-9_]", "[^A-Za-z0-9_]"
    between = f"(?:{edge}|{edge}.{{0,{max(0, within - 2)}}}{edge})"
    order = lambda a, b: F.regexp_like(text, F.lit(rf"(?is)(?:^|{edge}){a}{between}{b}(?:{edge}|$)"))
    assert re.fullmatch(f"{part}+", one + other)
    return order(one, other) | order(other, one)


def grounded_categories(text: Column, categories: dict[str, list[str]], connectives: list[str], within: int) -> Column:
    """Categories of which a keyword has a connective wholly within so many characters on either side; case does not count, and both are found inside words too."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def near(word: str, connective: str) -> Column:
        room = max(0, within - len(connective))
        pair = [rf"\Q{a}\E.{{0,{room}}}\Q{b}\E" for a, b in ((word, connective), (connective, word))]
        found = F.regexp_like(low, F.lit(f"(?s){pair[0]}|{pair[1]}"))
        for at in range(1 - len(connective), len(word)):  # the two may share letters
            start = min(0, at)
            joined = [connective[i - at] if 0 <= i - at < len(connective) else word[i] for i in range(start, max(len(word), at + len(connective)))]
            if "".join(joined[-start:][: len(word)]) == word:
                found = found | F.contains(low, F.lit("".join(joined)))
        return found

    hits = [F.coalesce(reduce(operator.or_, [near(w, c) for w in words for c in connectives]), F.lit(False)).cast("int") for words in categories.values()]
    return reduce(operator.add, hits)


def key_title(key: Column) -> Column:
    """A metadata key as words."""
    return F.replace(key, F.lit("_"), F.lit(" "))


def iso_time(time: Column) -> Column:
    """A UTC timestamp in ISO form, with microseconds where it has any."""
    whole = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.date_format(time, "SSSSSS")
    return F.concat(whole, F.when(part == "000000", "").otherwise(F.concat(F.lit("."), part)), F.lit("+00:00"))


def rendered(template: Column, values: Column) -> Column:
    """``{{ name }}`` replaced from a map of values, once; a missing name becomes empty."""
    name = r"\{\{\s*([A-Za-z0-9_]+)\s*\}\}"
    between = F.split(template, name, -1)
    found = F.transform(F.regexp_extract_all(template, F.lit(name), F.lit(1)), lambda n: F.coalesce(F.try_element_at(values, n), F.lit("")))
    return F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get(found, i), F.lit("")))), "")
