"""Quality rules with cross-document line frequency.

Base rules look at one document: its words, symbols, repeated lines and repeated
three-word windows. The method's own verdict looks across documents: lines are
normalised and hashed, the distinct documents that hold a line are counted per
host (here the source), lines above the limit are removed, and a document that
loses too large a share of its words is rejected.

Copies of one text are one document here: a document is named by all of its
normalised lines. Otherwise every copied text would look like boilerplate and its
whole group would be lost before duplicates are handled. Texts that differ in any
line count as different documents, near copies too: no rule can tell a large group
of them from documents that are mostly boilerplate.

Nulls and odd input: a null or empty text has no words and fails the base rules; a
null source is a host of its own; repeated rows get the same verdict; an empty
table gives an empty result; columns other than id, text and source are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLICE_ROWS, WORD, map_batches, stash

LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50
#: A line is boilerplate of a host when more distinct documents hold it than this, and than this share of the host's.
MOST_DOCUMENTS = 20
MOST_SHARE_PERCENT = 1
#: A document that loses more than this share of its words is depleted.
MOST_REMOVED_PERCENT = 50
SYMBOLS = "[#*$%&|<>]"
_SYMBOL_BYTES = b"#*$%&|<>"
_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    windows = (codes[:-2] * len(ids) + codes[1:-1]) * len(ids) + codes[2:] if len(ids) < 1_000_000 else np.unique(np.column_stack([codes[:-2], codes[1:-1], codes[2:]]), axis=0, return_inverse=True)[1].ravel()
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift : shift + n] |= again
    return int(covered.sum())


def base_counts(text: bytes | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    chars = b"".join(words)
    lines = [line for line in text.split(b"\n") if line.split(None, 1)]
    continuation = len(chars) - len(chars.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, _SYMBOL_BYTES))
    return len(words), len(chars) - continuation, symbols, len(lines) - len(set(lines)), repeated_words(words)


def _base_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            found = zip(*map(base_counts, part.column("text").to_pylist()), strict=True)
            kept = [part.column(c) for c in ("doc_id", "text_key", "source")]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(x, pa.int64()) for x in found)], ["doc_id", "text_key", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, source, the base counts and base_failed."""
    id_type, source_type = (docs.schema[c].dataType.simpleString() for c in ("doc_id", "source"))
    keyed = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "source", F.col("text").cast("binary").alias("text"))
    counted = map_batches(keyed, _base_batches, f"doc_id {id_type}, text_key long, source {source_type}, {_SCHEMA}")
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)
    return counted.withColumn("base_failed", failed)


def normalised(line: Column) -> Column:
    """Lower case, digits as 0, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]", "0"), r"[\x20\x09-\x0D]+", " "))


def host_lines(docs: DataFrame) -> DataFrame:
    """A row per document and line with a word: doc_id, text_key, source, line (hash), line_words, document (hash of all its lines)."""
    lines = F.filter(F.transform(F.split("text", "\n"), normalised), lambda x: x != "")
    narrow = docs.where(F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("text_key"), "source", lines.alias("lines")).where(F.size("lines") > 0)
    hashed = F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("line"), F.regexp_count(x, F.lit(WORD)).cast("long").alias("words")))
    document = F.xxhash64(F.array_join("lines", "\n"))
    rows = narrow.select("doc_id", "text_key", "source", document.alias("document"), F.explode(hashed).alias("l"))
    return rows.select("doc_id", "text_key", "source", "document", F.col("l.line").alias("line"), F.col("l.words").alias("line_words"))


def boilerplate(lines: DataFrame) -> DataFrame:
    """(source, line) held by more distinct documents of the host than the limits allow."""
    held = lines.select("source", "line", "document").distinct().groupBy("source", "line").agg(F.count("*").alias("held_by"))
    hosts = lines.select("source", "document").distinct().groupBy("source").agg(F.count("*").alias("documents"))
    both = held.where(F.col("held_by") > MOST_DOCUMENTS).alias("h").join(hosts.alias("o"), F.col("h.source").eqNullSafe(F.col("o.source")))
    return both.where(F.col("held_by") * 100 > F.col("documents") * MOST_SHARE_PERCENT).select("h.source", "line")


def removed_words(lines: DataFrame, found: DataFrame) -> DataFrame:
    """Words that each document loses with its boilerplate lines: doc_id, text_key, removed_words, copies."""
    hit = lines.alias("l").join(found.alias("f"), F.col("l.source").eqNullSafe(F.col("f.source")) & (F.col("l.line") == F.col("f.line")))
    return hit.groupBy("l.doc_id", "l.text_key", "l.source").agg(F.sum("line_words").alias("removed_words"))


def judge(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, the base counts, base_failed, removed_words and kept."""
    rules = stash(base_rules(docs), "rules")
    lines = stash(host_lines(docs), "lines")
    lost = removed_words(lines, boilerplate(lines)).alias("x")
    times = rules.groupBy("doc_id", "text_key", "source").agg(F.count("*").alias("times")).where(F.col("times") > 1).alias("t")
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key")) & F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    lost = lost.join(times, same("x", "t"), "left").select("x.doc_id", "x.text_key", "x.source", (F.col("removed_words") / F.coalesce("times", F.lit(1))).cast("long").alias("removed_words")).alias("x")
    both = rules.alias("r").join(lost, same("r", "x"), "left")
    removed = F.coalesce("removed_words", F.lit(0).cast("long"))
    kept = ~F.col("base_failed") & (removed * 100 <= F.col("n_words") * MOST_REMOVED_PERCENT)
    return both.select("r.*", removed.alias("removed_words"), kept.alias("kept"))
