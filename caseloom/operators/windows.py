"""Words near mentions, by their positions: postings of both, joined by band."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bundles import EDIT_WORDS


def postings(texts: DataFrame, key: str, text: str, terms: str) -> DataFrame:
    """(key, term, start): where each of a row's terms occurs in its text, letter case aside; occurrences of one term do not overlap."""
    narrow = texts.select(F.col(key).alias("key"), F.col(text).alias("text"), F.array_distinct(terms).alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key_value, held, wanted in zip(batch.column("key"), batch.column("text"), batch.column("terms"), strict=True):
                low = (held.as_py() or "").lower()
                for term in wanted.as_py() or ():
                    starts, step = [], (term or "").lower()
                    at = low.find(step) if step else -1
                    while at >= 0:
                        starts.append(at)
                        at = low.find(step, at + len(step))
                    if starts:
                        n = len(starts)
                        yield pa.RecordBatch.from_arrays([pa.array([key_value.as_py()] * n, batch.column("key").type), pa.array([term] * n), pa.array(starts, pa.int64())], ["key", "term", "start"])

    found = narrow.mapInArrow(run, f"key {narrow.schema['key'].dataType.simpleString()}, term string, start long")
    return found.withColumnRenamed("key", key)


def window_scores(texts: DataFrame, key: str, text: str, mentions: str, words: list[tuple[str, int]] = EDIT_WORDS, around: int = 120) -> DataFrame:
    """(key, mention, n, score) of a row's mentions that occur in its text: over its places, the weights of the distinct words that stand whole within ``around`` characters of it.

    Places of mentions and words are read once each. A place's window covers a few
    bands of positions, so the two meet by an equality join on key and band and only
    then by range: the work follows the places, not their pairs.
    """
    longest = max(len(w) for w, _ in words)
    band = 2 * around + longest
    places = postings(texts, key, text, mentions).withColumn("stop", F.col("start") + F.char_length("term"))
    low, high = F.greatest(F.col("start") - around, F.lit(0)), F.col("stop") + around
    windows = places.select(key, F.col("term").alias("mention"), "start", low.alias("low"), high.alias("high"))
    banded = windows.withColumn("band", F.explode(F.sequence(F.floor(F.col("low") / band), F.floor(F.col("high") / band))))
    given = texts.select(key, text).withColumn("words", F.array(*[F.lit(w) for w, _ in words]))
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in words for x in pair]), F.col("term"))
    near = postings(given, key, text, "words").select(key, F.col("start").alias("at"), "term", weight.alias("weight"), F.floor(F.col("start") / band).alias("band"))
    inside = (F.col("at") >= F.col("low")) & (F.col("at") + F.char_length("term") <= F.col("high"))
    met = banded.join(near, [key, "band"]).where(inside).select(key, "mention", "start", "term", "weight").distinct()
    scored = met.groupBy(key, "mention").agg(F.sum("weight").cast("long").alias("score"))
    counted = windows.groupBy(key, "mention").agg(F.count("*").alias("n"))
    return counted.join(scored, [key, "mention"], "left").na.fill(0, ["score"])
