"""Mixing sources to target weights by capped water-filling.

Every source asks for its weight's share of the mix and stops at a maximum number
of epochs; what it cannot take is shared again among the others in proportion to
their weights until no source is above its stop. The level where that ends needs
no loop: with sources in the order of stop / weight, the level is the largest
over k of (words asked for - stops of the first k) / (weights of the rest).

A source then takes each document ``whole`` times, and once more the documents
that come first in a seeded order of the source until its words are reached; the
document in which they are reached is repeated in part.

Nulls and odd input: a null source is a source of its own (last), a null text has
no words, an empty table gives an empty mix, sources without words get a target
of 0, and repeated rows are documents like any other. Columns other than id,
source and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import WORD, n_words, stash

#: Stretches of the seeded order in which words are summed before they are run up, per source.
STRETCHES = 4096
_PLACE_DIGITS = 15


def place(id_col: Column, text_col: Column, seed: int) -> Column:
    """A document's place in the seeded order: 60 bits of a digest of seed, id and text, so that rows that share an id, or have none, are spread."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(id_col.cast("string"), F.lit("null")), F.sha2(F.coalesce(text_col, F.lit("")).cast("binary"), 256))
    return F.conv(F.substring(F.sha2(text, 256), 1, _PLACE_DIGITS), 16, 10).cast("long")


def source_targets(totals: DataFrame, weights: list[float], share: float, max_epochs: float) -> DataFrame:
    """Targets of the sources of ``totals`` (source, source_size): one row per source.

    Sources take ``weights`` in turn by code point, null last, and share ``share``
    times all words; no target is above ``max_epochs`` times its source's words.
    """
    everything = Window.partitionBy()
    ranked = totals.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("stop", F.col("source_size") * F.lit(float(max_epochs)))
    filling = Window.orderBy(F.col("stop") / F.col("weight"), "nth")
    stops_before = F.coalesce(F.sum("stop").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weights_left = F.sum("weight").over(filling.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    asked = F.sum("source_size").over(everything) * F.lit(float(share))
    level = ranked.withColumn("level", (asked - stops_before) / weights_left)
    target = F.least("stop", F.col("weight") * F.max("level").over(everything))
    return level.withColumn("target", F.greatest(target, F.lit(0.0))).select("source", "source_size", "weight", "target")


def mix(docs: DataFrame, weights: list[float], share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """What the mix takes of each document: id, source, size, source_size, target, whole, extra, taken.

    ``whole`` repetitions plus ``extra`` words of one more. Words are counted once,
    into a narrow table; sums run over (source, stretch) before rows, so a source
    with any share of all documents is spread over all tasks.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), place(F.col(id_col), F.col(text_col), seed).alias("place"))
    sized = stash(sized.withColumn("stretch", F.floor(F.col("place") / F.lit(16**_PLACE_DIGITS // STRETCHES)).cast("int")), "sized")
    stretches = sized.groupBy("source", "stretch").agg(F.sum("size").alias("stretch_size"))
    totals = stretches.groupBy("source").agg(F.sum("stretch_size").alias("source_size"))
    targets = source_targets(totals, weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("quota", F.floor(F.col("target") + F.lit(0.5)).cast("long") - F.col("whole") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    plan = stretches.withColumn("before", F.coalesce(F.sum("stretch_size").over(before), F.lit(0))).alias("p")
    plan = plan.join(targets.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source"))).select("p.source", "stretch", "before", "source_size", "target", "whole", "quota").alias("p")
    joined = sized.alias("d").join(plan, F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.stretch") == F.col("p.stretch")))
    rows = joined.select("doc_id", F.col("d.source").alias("source"), "size", "place", F.col("d.stretch").alias("stretch"), "before", "source_size", "target", "whole", "quota")
    inside = Window.partitionBy("source", "stretch").orderBy("place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    extra = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("quota") - reached))
    rows = rows.withColumn("extra", extra)
    return rows.select(F.col("doc_id").alias(id_col), "source", "size", "source_size", "target", "whole", "extra", (F.col("whole") * F.col("size") + F.col("extra")).alias("taken"), "place")


def repeat(docs: DataFrame, weights: list[float], share: float = 1.5, max_epochs: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; part of a repetition counts as one from half of it on.

    What a source takes once more is a stretch from the start of its seeded order,
    so one place per source says it all: texts are not shuffled, only that small
    table is. Texts without words are taken whole times only.
    """
    mixed = mix(docs, weights, share, max_epochs, seed, id_col, text_col, source_col)
    once_more = (F.col("size") > 0) & (F.col("extra") * 2 >= F.col("size"))
    last = stash(mixed.groupBy("source").agg(F.max("whole").alias("whole"), F.max(F.when(once_more, F.col("place"))).alias("last_place")), "places")
    joined = docs.alias("d").join(last.alias("t"), F.col(f"d.`{source_col}`").eqNullSafe(F.col("t.source")))
    more = F.regexp_like(F.col(f"d.`{text_col}`"), F.lit(WORD)) & (place(F.col(f"d.`{id_col}`"), F.col(f"d.`{text_col}`"), seed) <= F.col("t.last_place"))
    copies = (F.col("t.whole") + F.when(more, 1).otherwise(0)).cast("int")
    row = F.struct(*[F.col(f"d.`{c}`") for c in docs.columns])
    return joined.select(F.explode(F.array_repeat(row, copies)).alias("row")).select("row.*")
