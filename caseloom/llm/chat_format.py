"""Chat formatting with Spark expressions only.

Turns are collected as structs and sorted, adjacent turns of one role share one
block, and blocks are concatenated: ``<s>role\\ntext</s>``, with ``<sep>`` between
the texts of a block. Control strings cannot occur inside roles or texts, since
``&``, ``<`` and ``[`` are escaped there; unescaping gives the text back.

Nulls and odd input: a null text or role is empty; turns with equal numbers are
ordered by role and text, and a null number comes first; repeated rows are turns
of their own; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, SEPARATOR = "<s>", "</s>", "<sep>"
#: Role whose texts are trained on.
TRAINED = "assistant"
#: Escapes, applied in this order and undone in reverse.
_ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]
_CHUNK_CHARS, _BLOCK_RUNS = 1024, 256


def escaped(text: Column) -> Column:
    for plain, escape in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escape))
    return text


def unescaped(text: Column) -> Column:
    for plain, escape in reversed(_ESCAPES):
        text = F.replace(text, F.lit(escape), F.lit(plain))
    return text


def format_conversations(turns: DataFrame) -> DataFrame:
    """Per conversation of ``turns`` (conv_id, turn, role, text): formatted and loss_mask.

    The mask lists runs of the formatted text in order: characters, and whether they are trained on.
    """
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def piece(turn: Column, i: Column) -> Column:
        starts = (i == 0) | (F.col("turns")[F.greatest(i - 1, F.lit(0))]["role"] != turn["role"])
        ends = (i == F.size("turns") - 1) | (F.get("turns", i + 1)["role"] != turn["role"])
        before = F.when(starts, F.concat(F.lit(OPEN), escaped(turn["role"]), F.lit("\n"))).otherwise(F.lit(SEPARATOR))
        return F.struct(before.alias("before"), escaped(turn["text"]).alias("text"), F.when(ends, F.lit(CLOSE)).otherwise(F.lit("")).alias("after"), (turn["role"] == TRAINED).alias("trained"))

    pieces = grouped.select("conv_id", F.transform("turns", piece).alias("pieces"))
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], p["text"], p["after"])), "")
    runs = F.flatten(F.transform("pieces", lambda p: F.array(_run(p["before"], F.lit(False)), _run(p["text"], p["trained"]), _run(p["after"], F.lit(False)))))
    return pieces.select("conv_id", formatted.alias("formatted"), F.filter(runs, lambda r: r["chars"] > 0).alias("loss_mask"))


def _run(text: Column, trained: Column) -> Column:
    return F.struct(F.length(text).alias("chars"), trained.alias("trained"))


def turns_of(formatted: Column) -> Column:
    """The turns that a formatted text holds, as an array of (role, text)."""
    blocks = F.filter(F.split(formatted, CLOSE), lambda b: b != "")

    def block_turns(block: Column) -> Column:
        role = F.substring_index(F.substring(block, len(OPEN) + 1, 1 << 30), "\n", 1)
        texts = F.split(F.substr(block, F.length(role) + F.lit(len(OPEN) + 2)), SEPARATOR)
        return F.transform(texts, lambda t: F.struct(unescaped(role).alias("role"), unescaped(t).alias("text")))

    return F.flatten(F.transform(blocks, block_turns))


def trained_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the mask, unescaped, read from the formatted text by the mask's runs.

    The text is cut into chunks and the mask into blocks of runs, both of a fixed size, so
    that a run is found and read without going through all that stands before it.
    """
    chunks = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{_CHUNK_CHARS}}}"), F.lit(0))
    texts = _let(chunks, lambda parts: F.transform(_trained_runs(loss_mask), lambda run: _read(parts, run["at"], run["chars"])))
    return unescaped(F.array_join(texts, ""))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def _trained_runs(loss_mask: Column) -> Column:
    """(at, chars) of the mask's trained runs, counted from 0."""
    none = F.expr("CAST(array() AS array<struct<at: bigint, chars: int>>)")
    zero = F.lit(0).cast("long")

    def within(block: Column, first: Column) -> Column:
        def step(s: Column, run: Column) -> Column:
            found = F.array_append(s["found"], F.struct(s["at"].alias("at"), run["chars"].alias("chars")))
            return F.struct((s["at"] + run["chars"]).alias("at"), F.when(run["trained"], found).otherwise(s["found"]).alias("found"))

        return F.aggregate(block, F.struct(first.alias("at"), none.alias("found")), step)["found"]

    def over(blocks: Column) -> Column:
        sizes = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda total, run: total + run["chars"]))
        firsts = F.aggregate(sizes, F.array(zero), lambda known, size: F.array_append(known, F.element_at(known, -1) + size))
        return _let(firsts, lambda known: F.flatten(F.transform(blocks, lambda block, i: within(block, F.get(known, i)))))

    def blocks_of(mask: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(mask), F.lit(_BLOCK_RUNS)), lambda i: F.slice(mask, i, _BLOCK_RUNS))

    return _let(loss_mask, lambda mask: F.when(F.size(mask) > 0, _let(blocks_of(mask), over)).otherwise(none))


def _read(chunks: Column, at: Column, chars: Column) -> Column:
    """``chars`` characters from ``at`` of the text that was cut into ``chunks``."""
    skipped = (at % _CHUNK_CHARS).cast("int")
    wanted = F.floor((skipped + chars - 1) / _CHUNK_CHARS).cast("int") + 1
    return F.substr(F.array_join(F.slice(chunks, F.floor(at / _CHUNK_CHARS).cast("int") + 1, wanted), ""), skipped + 1, chars)


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from formatted conversations: turn count, digests of turns and trained text, sizes."""
    read = formatted.select("conv_id", "formatted", turns_of(F.col("formatted")).alias("turns"), trained_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
