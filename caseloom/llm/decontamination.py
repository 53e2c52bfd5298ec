"""Benchmark decontamination: containment search for short test items inside long documents.

Items are partitioned by the size of their shingle set into power-of-two classes.
An item's sketch holds so many of its shingles that an item of which at least
``CONTAINED_PERCENT`` is in a document must share one of them with it: the shingles
missing from the document are fewer than the sketch. Larger classes need larger
sketches. Any order of the shingles will do, so the one of MinHash values is only the
second key: first come the shingles that the fewest documents hold. A phrase that
many items and documents share is so in no sketch, unless it is most of the item and
each of these documents is a match.

Documents are hashed whole, once. For each class, a bitmap of its items' shingles (one
of fixed size for all classes, so it can be broadcast whatever the benchmark holds)
lets through the shingles that items of that class may have; they are counted, the
sketches are made, and a join by class and shingle gives the candidates. A document's
candidates are listed, the text meets the list once (once for each ``LIST_ITEMS``
candidates, about, where a document has very many), and the exact share of each item's
shingles decides. Items of equal sets are one until the end. Neither items nor hits
pass through the driver.

Items of fewer than ``least_words`` words (a shingle, unless asked otherwise) are
no evidence, since every document that holds a common phrase would match; they are
not searched, and ``left_out`` lists them. Where shorter items are asked for, each
is one shingle of all its words among the documents' windows of that many words.

Nulls and odd input: items and documents without words match nothing; repeated
rows match like any other, each giving its rows; empty tables give no rows; a null
id is returned as it is; very long texts are searched whole, by one task; columns
other than ids and texts are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BITMAP_BITS, SHINGLE_WORDS, SLICE_ROWS, WordHashes, bitmap_bucket, bitmap_may_hold, common_size, grams, hashed_words, key_bitmap, map_batches, n_words, stash

CONTAINED_PERCENT = 75
#: Candidates that meet a document's text at once, about.
LIST_ITEMS = 256


def size_class(n_shingles: int) -> int:
    return (n_shingles - 1).bit_length() if n_shingles > 1 else 0


def sketch_size(n_shingles: int) -> int:
    """Shingles that cannot all be missing from a document that holds enough of the item.

    Sized by the largest item of the power-of-two class, and never more than the item has.
    """
    largest = 1 << size_class(n_shingles)
    return min(n_shingles, largest - -(-largest * CONTAINED_PERCENT // 100) + 1)


def in_class(shingles: np.ndarray, size_class: int) -> np.ndarray:
    """Shingles as values of a class: an odd factor of its own, so that equal shingles of several classes are told apart and none collide."""
    return (shingles * np.uint64((0x9E3779B97F4A7C15 * (2 * size_class + 1)) % (1 << 64) | 1)).view(np.int64)


def _item_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        where, widths, sets = [], [], []
        for nth, text in enumerate(batch.column("text").to_pylist()):
            words = hashed_words(text, cache)
            if len(words):
                where.append(nth)
                widths.append(min(SHINGLE_WORDS, len(words)))
                sets.append(np.unique(grams(words, widths[-1])).tobytes())
        at = pa.array(where, pa.int64())
        columns = [batch.column("item_id").take(at), batch.column("times").take(at), pa.array(widths, pa.int32()), pa.array(sets, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["item_id", "times", "width", "shingles"])


def hashed_items(items: DataFrame, least_words: int = SHINGLE_WORDS) -> DataFrame:
    """Distinct items that are searched: item_id, times (their rows), width, shingles."""
    kind = items.schema["item_id"].dataType.simpleString()
    searched = items.where(n_words(F.col("text")) >= F.lit(max(1, least_words)))
    once = searched.groupBy("item_id", F.col("text").cast("binary").alias("text")).agg(F.count("*").alias("times"))
    return map_batches(once, _item_batches, f"item_id {kind}, times long, width int, shingles binary")


def _value_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item_set, width, held in zip(*(batch.column(c).to_pylist() for c in ("item_set", "width", "shingles")), strict=True):
            shingles = np.frombuffer(held, np.uint64)
            n, own = len(shingles), size_class(len(shingles))
            constant = lambda x, kind: pa.array(np.full(n, x), kind)  # noqa: B023, E731
            columns = [constant(item_set, pa.int64()), constant(width, pa.int32()), constant(own, pa.int32()), pa.array(in_class(shingles, own)), constant(sketch_size(n), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["item_set", "width", "size_class", "value", "sketch"])


def left_out(items: DataFrame, least_words: int = SHINGLE_WORDS) -> DataFrame:
    """The item rows that are too short to be searched, null and empty ones among them."""
    return items.where(n_words(F.col("text")) < F.lit(max(1, least_words)))


def _hit_function(shared):
    """Distinct shingles of a document that items of a class may have, for each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, (classes, bitmap) = WordHashes(), shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                where, kinds, values = [], [], []
                for nth, text in enumerate(part.column("text").to_pylist()):
                    words = hashed_words(text, cache)
                    for width, sizes in classes:
                        own = grams(words, width)
                        for size in sizes if len(own) else ():
                            value = in_class(own, size)
                            bit = (value % BITMAP_BITS - 1) % BITMAP_BITS
                            hit = np.unique(value[(bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1])
                            if len(hit):
                                where.append(np.full(len(hit), nth))
                                kinds.append(np.full(len(hit), size))
                                values.append(hit)
                if where:
                    at = pa.array(np.concatenate(where), pa.int64())
                    columns = [part.column("doc_id").take(at), part.column("text_key").take(at), pa.array(np.concatenate(kinds), pa.int32()), pa.array(np.concatenate(values))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "size_class", "value"])

    return run


def _bitmap_bytes(values: DataFrame) -> np.ndarray:
    """The bitmap of a long column: BITMAP_BITS bits, whatever the column holds. Spark counts places from 1, so the one for 0 comes last."""
    held = np.zeros(BITMAP_BITS // 8, np.uint8)
    for row in key_bitmap(values, "value").collect():  # at most 1025 rows, 4 MB together
        part = np.frombuffer(bytes(row["bits"]), np.uint8)
        if row["bucket"] == 0:
            held[-1] |= 0x80
        else:
            at = (row["bucket"] - 1) * len(part)
            held[at : at + len(part)] |= part
    return held


def document_hits(narrow: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, text_key, size_class, value): which values of the items each document row may hold."""
    context = narrow.sparkSession.sparkContext
    kinds: dict[int, list[int]] = {}
    for row in values.select("width", "size_class").distinct().sort("width", "size_class").collect():  # five widths, and classes by the logarithm of the size
        kinds.setdefault(row["width"], []).append(row["size_class"])
    shared = context.broadcast((sorted(kinds.items()), _bitmap_bytes(values)))
    hits = stash(map_batches(narrow, _hit_function(shared), f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, text_key long, size_class int, value long"), "hits")
    shared.destroy()
    return hits


def sketches(values: DataFrame, hits: DataFrame) -> DataFrame:
    """(item_set, size_class, value): of each item the values that the fewest documents hold, without those that none holds."""
    held = stash(hits.groupBy("size_class", "value").agg(F.count("*").alias("held_by")), "held")
    counted = values.join(held, ["size_class", "value"], "left")
    nth = F.row_number().over(Window.partitionBy("item_set").orderBy(F.col("held_by").asc_nulls_first(), "value"))
    return counted.withColumn("nth", nth).where((F.col("nth") <= F.col("sketch")) & F.col("held_by").isNotNull()).select("item_set", "size_class", "value")


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(start, SLICE_ROWS)
            kept, sets, sizes, found = [], [], [], []
            for nth, (text, asked) in enumerate(zip(part.column("text").to_pylist(), part.column("asked"), strict=True)):
                words, own = hashed_words(text, cache), {}
                for item in asked.as_py():
                    width, shingles = item["width"], np.frombuffer(item["shingles"], np.uint64)
                    if width not in own:
                        own[width] = np.unique(grams(words, width))
                    shared = common_size(own[width], shingles)
                    if shared * 100 >= CONTAINED_PERCENT * len(shingles):
                        kept.append(nth)
                        sets.append(item["item_set"])
                        sizes.append(len(shingles))
                        found.append(shared)
            where = pa.array(kept, pa.int64())
            columns = [part.column(c).take(where) for c in ("doc_id", "text_key")]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in (sets, sizes, found))], ["doc_id", "text_key", "item_set", "n_item", "n_shared"])


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = SHINGLE_WORDS) -> DataFrame:
    """(id, text_key, item_id, n_item, n_shared): items of which a document holds enough, one row per document row and item row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    searched = stash(hashed_items(items, least_words), "items")
    sets = stash(searched.select("width", "shingles").distinct().withColumn("item_set", F.monotonically_increasing_id()), "sets")
    values = stash(map_batches(sets, _value_batches, "item_set long, width int, size_class int, value long, sketch int"), "values")
    narrow = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text"))
    hits = document_hits(narrow, values)
    met = hits.join(stash(sketches(values, hits), "sketches"), ["size_class", "value"])
    candidates = stash(met.select("doc_id", "text_key", "item_set").distinct(), "candidates")
    n_lists = max(1, sets.count() // LIST_ITEMS)
    listed = candidates.join(sets, "item_set").groupBy("doc_id", "text_key", F.pmod(F.xxhash64("item_set"), F.lit(n_lists)).alias("list"))
    listed = stash(listed.agg(F.collect_list(F.struct("item_set", "width", "shingles")).alias("asked")), "asked")
    likely = narrow.join(F.broadcast(key_bitmap(candidates, "text_key")), bitmap_bucket(F.col("text_key")) == F.col("bucket")).where(bitmap_may_hold(F.col("bits"), F.col("text_key")))
    same_document = F.col("d.doc_id").eqNullSafe(F.col("a.doc_id")) & (F.col("d.text_key") == F.col("a.text_key"))
    both = likely.select("doc_id", "text_key", "text").alias("d").join(listed.alias("a"), same_document).select("d.doc_id", "d.text_key", "d.text", "a.asked")
    found = map_batches(both, _verify_batches, f"doc_id {id_type}, text_key long, item_set long, n_item long, n_shared long")
    members = searched.join(sets, ["width", "shingles"]).select("item_set", "item_id", "times")
    each = found.join(members, "item_set").withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return each.select(F.col("doc_id").alias(id_col), "text_key", "item_id", "n_item", "n_shared")
