"""Removal of passages that repeat across documents, by hashes of units that stand inside lines too.

A passage is repeated if ``least_words`` words in a row, A-Z lower-cased and apart
from white space, also occur earlier, by document id, text and place, without
overlap. The earliest occurrence is kept; of every other the words that any such
window covers are given as runs, with offsets in code points of the text.

Lines as units miss passages inside a line, so a unit here is a paragraph whose
bounds the words set: a bound lies between two words whose joint hash falls in one
of ``BOUND`` classes, so that a passage is cut alike wherever it stands. Digests of
units are grouped over the whole corpus. A window can only be repeated if all
units inside it are, so only such windows, and the few that hold no whole unit,
are hashed themselves, and these hashes are grouped in turn: the earliest stays.
First, though, stretches of such windows between bounds are hashed as a whole: all
windows of a stretch that stands earlier too are repeated, so that only those of
its first occurrence go on, and long repeats cost little.
Units of a few words are in every text and decide nothing. Copies of whole texts
are told by one digest and take no part in this; a window that a text has more
than once is one row with all its places.

Nulls and odd input: a null text, or one with fewer words than a passage, has no
rows; a null id ranks first; rows equal in id and text are one document, so a
repeated row does not remove its like; two texts with one id are two documents;
an empty table gives no rows; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import SLICE_ROWS, WordHashes, bitmap_bucket, bitmap_may_hold, finalise, hashed_words, key_bitmap, map_batches, stash

LEAST_WORDS = 50
#: One in so many places between two words is a bound of units.
BOUND = 8
#: Units of fewer words are left out.
LEAST_UNIT = 4
#: One in so many places between two words (a multiple of BOUND) is a bound of stretches.
STRETCH_BOUND = 16
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True


class Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as were asked for."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


def spans(hashes: np.ndarray, first: np.ndarray, last: np.ndarray, powers: Powers) -> np.ndarray:
    """A hash of the words from ``first`` up to ``last`` (not included), for arrays of both."""
    up, down = powers.of(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)])])
    return finalise((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))


def bounds(hashes: np.ndarray, every: int = BOUND) -> np.ndarray:
    """Numbers of the words before which a unit ends and the next begins."""
    both = finalise(hashes[:-1] + finalise(hashes[1:]))
    return np.flatnonzero(both % np.uint64(every) == 0) + 1


class Units:
    """The units of a text that count: where they begin and end, in words, and how many of them each window of ``least`` words holds whole."""

    def __init__(self, hashes: np.ndarray, least: int):
        cuts = bounds(hashes)
        counts = np.diff(cuts) >= LEAST_UNIT
        self.low, self.high = cuts[:-1][counts], cuts[1:][counts]
        at = np.arange(len(hashes) - least + 1)
        # a bound is known from the words on both sides of it, so both must stand in the window
        self.first = np.searchsorted(self.low, at + 1)
        self.behind = np.maximum(np.searchsorted(self.high, at + least - 1, "right"), self.first)


def places(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code points before each word and up to its end."""
    raw = np.frombuffer(text, np.uint8)
    word = np.concatenate([[False], ~_SPACES[raw], [False]])
    edges = np.flatnonzero(word[1:] != word[:-1])
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points[edges[::2]], points[edges[1::2]]


class Hasher:
    """Hashes of one worker: words, units, windows."""

    def __init__(self, least: int):
        self.least, self.cache = least, WordHashes()
        self.powers = [Powers(b) for b in _BASES]

    def words(self, text: bytes | None) -> np.ndarray:
        return hashed_words(text, self.cache)

    def window_rows(self, text: bytes, hashes: np.ndarray, at: np.ndarray) -> tuple[list[np.ndarray], list[list[int] | None]]:
        """hash, check, at, start and end of the windows that begin at the words ``at``, equal ones at their first place; and at, start and end of their other places."""
        start, end = places(text)
        value = spans(hashes, at, at + self.least, self.powers[0])
        check = spans(finalise(hashes), at, at + self.least, self.powers[1]) >> np.uint64(33)
        numbers = np.stack([value.view(np.int64), check.astype(np.int64), at, start[at], end[at + self.least - 1]])
        order = np.lexsort((at, check, value))
        fresh = np.concatenate([[True], (value[order[1:]] != value[order[:-1]]) | (check[order[1:]] != check[order[:-1]])])
        heads = np.flatnonzero(fresh)
        sizes = np.diff(np.concatenate([heads, [len(order)]]))
        more = [None if n == 1 else numbers[2:, order[h + 1 : h + n]].T.ravel().tolist() for h, n in zip(heads, sizes, strict=True)]
        return numbers[:, order[heads]], more


_NUMBERS = ["hash", "check", "at", "start", "end"]
_WINDOW_SCHEMA = "hash long, check int, at int, start int, end int, more array<int>"
_MORE = pa.list_(pa.int32())


def _numbers(rows: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array(rows[0], pa.int64()), *(pa.array(x.astype(np.int32), pa.int32()) for x in rows[1:])]


def _piece_function(least: int):
    """Rows of three kinds: a document (``unit`` -1: at is its number of words), a unit of it (from the end of the unit before to the start of the one behind), and (``unit`` null) a window without a whole unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(least)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                docs, whole, units, tables, open_docs, open_windows, more = [], [], [], [], [], [], []
                for nth, text in enumerate(part.column("text").to_pylist()):
                    hashes = hasher.words(text)
                    n_words = len(hashes)
                    if n_words < least:
                        continue
                    own, (low, high) = Units(hashes, least), places(text)
                    n = len(own.low)
                    table = np.zeros((5, n + 1), np.int64)
                    table[2:, 0] = n_words, low[0], high[-1]
                    if n:
                        table[0, 1:] = spans(hashes, own.low, own.high, hasher.powers[0]).view(np.int64)
                        table[2, 1:] = np.concatenate([[0], own.low[:-1]])
                        table[3, 1:] = np.concatenate([own.high[1:], [n_words]])
                    docs.append(np.full(n + 1, nth))
                    whole += [xxhash.xxh3_128_digest(hashes.tobytes())] * (n + 1)
                    units.append(np.arange(-1, n))
                    tables.append(table)
                    bare = np.flatnonzero(own.behind == own.first)
                    if len(bare):
                        numbers, others = hasher.window_rows(text, hashes, bare)
                        open_docs.append(np.full(numbers.shape[1], nth))
                        open_windows.append(numbers)
                        more += others
                if not docs:
                    continue
                who = pa.array(np.concatenate(docs + open_docs), pa.int64())
                numbers = _numbers(list(np.concatenate(tables + open_windows, axis=1)))
                unit = pa.concat_arrays([pa.array(np.concatenate(units), pa.int32()), pa.nulls(len(more), pa.int32())])
                keys = pa.concat_arrays([pa.array(whole, pa.binary()), pa.nulls(len(more), pa.binary())])
                rest = pa.concat_arrays([pa.nulls(len(whole), _MORE), pa.array(more, _MORE)])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(who), part.column("text_key").take(who), keys, unit, *numbers, rest], ["doc_id", "text_key", "whole", "unit", *_NUMBERS, "more"])

    return run


class Candidates:
    """The windows of a text whose units, at least one, are all among the given ones, and the stretches of them between bounds: from ``low`` up to ``high``, not included."""

    def __init__(self, hashes: np.ndarray, units: np.ndarray, least: int):
        own = Units(hashes, least)
        known = np.zeros(len(own.low) + 1, np.int64)
        known[units + 1] = 1
        upto = np.cumsum(known)
        self.hold = (own.behind > own.first) & (upto[own.behind] - upto[own.first] == own.behind - own.first)
        cuts = bounds(hashes, STRETCH_BOUND)
        cuts = cuts[cuts <= len(self.hold)]
        held = np.concatenate([[0], np.cumsum(self.hold)])
        low, high = cuts[:-1], cuts[1:]
        whole = held[high] - held[low] == high - low
        self.low, self.high = low[whole], high[whole]


def _stretch_function(least: int):
    """Stretches of candidate windows: hash and check of all their words, the first window's word, where the words start and end, and the number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(least)
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(begin, SLICE_ROWS)
                docs, rows = [], []
                for nth, (text, units) in enumerate(zip(part.column("text").to_pylist(), part.column("units"), strict=True)):
                    hashes = hasher.words(text)
                    found = Candidates(hashes, np.asarray(units.values), least)
                    if len(found.low):
                        behind = found.high + least - 1
                        value = spans(hashes, found.low, behind, hasher.powers[0])
                        check = spans(finalise(hashes), found.low, behind, hasher.powers[1]) >> np.uint64(33)
                        start, end = places(text)
                        docs.append(np.full(len(value), nth))
                        rows.append(np.stack([value.view(np.int64), check.astype(np.int64), found.low, start[found.low], end[behind - 1], found.high - found.low]))
                if docs:
                    who = pa.array(np.concatenate(docs), pa.int64())
                    columns = [part.column("doc_id").take(who), part.column("text_key").take(who), *_numbers(list(np.concatenate(rows, axis=1)))]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", *_NUMBERS, "n"])

    return run


def _window_function(least: int):
    """Candidate windows but those of the stretches that are known to be repeated (from ``lows``); ``opens`` marks rows with a window that opens a stretch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(least)
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(begin, SLICE_ROWS)
                docs, rows, more, opens = [], [], [], []
                for nth, (text, units, lows) in enumerate(zip(part.column("text").to_pylist(), part.column("units"), part.column("lows"), strict=True)):
                    hashes = hasher.words(text)
                    found = Candidates(hashes, np.asarray(units.values), least)
                    hold = found.hold.copy()
                    if lows.is_valid:
                        known = np.isin(found.low, np.asarray(lows.values))
                        for low, high in zip(found.low[known], found.high[known], strict=True):
                            hold[low:high] = False
                    at = np.flatnonzero(hold)
                    if len(at):
                        numbers, others = hasher.window_rows(text, hashes, at)
                        docs.append(np.full(numbers.shape[1], nth))
                        rows.append(numbers)
                        more += others
                        first = np.zeros(len(hold), bool)
                        first[found.low] = True
                        opens += [bool(first[a]) or (x is not None and bool(first[x[::3]].any())) for a, x in zip(numbers[2].tolist(), others, strict=True)]
                if docs:
                    who = pa.array(np.concatenate(docs), pa.int64())
                    columns = [part.column("doc_id").take(who), part.column("text_key").take(who), *_numbers(list(np.concatenate(rows, axis=1))), pa.array(more, _MORE), pa.array(opens, pa.bool_())]
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", *_NUMBERS, "more", "opens"])

    return run


def _same_document(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text"))


def _copies(pieces: DataFrame) -> DataFrame:
    """Documents whose words an earlier document has in the same order: one run each."""
    documents = pieces.where(F.col("unit") == -1)
    firsts = documents.groupBy("whole").agg(F.min(F.struct("doc_id", "text_key", "start")).alias("first"), F.max(F.struct("doc_id", "text_key")).alias("last"))
    several = firsts.where(~(F.struct("first.doc_id", "first.text_key").eqNullSafe(F.col("last")))).drop("last")
    joined = documents.alias("d").join(stash(several, "firsts").alias("f"), "whole").where(~(F.col("d.doc_id").eqNullSafe(F.col("f.first.doc_id")) & (F.col("d.text_key") == F.col("f.first.text_key"))))
    return joined.select("d.doc_id", "d.text_key", "d.start", "d.end", F.col("d.at").alias("words"), F.col("f.first.doc_id").alias("first_doc_id"), F.col("f.first.start").alias("first_start")).distinct()


def _marked_texts(pieces: DataFrame, copies: DataFrame, keyed: DataFrame, least: int) -> DataFrame:
    """(doc_id, text_key, text, units): documents, no copies, in which a window fits between units that do not occur again, with those that do."""
    units = pieces.where(F.col("unit") >= 0).select("doc_id", "text_key", "unit", "hash", F.col("at").alias("low"), F.col("start").alias("high"), F.xxhash64("whole", "unit").alias("place"))
    ends = units.groupBy("hash").agg(F.min("place").alias("least"), F.max("place").alias("most"))
    again = units.drop("place").join(stash(ends.where(F.col("least") != F.col("most")).select("hash"), "repeated"), "hash")
    island = F.col("unit") - F.dense_rank().over(Window.partitionBy("doc_id", "text_key").orderBy("unit"))
    together = again.withColumn("island", island).groupBy("doc_id", "text_key", "island").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.collect_set("unit").alias("units"))
    marks = together.where(F.col("high") - F.col("low") >= least).groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("units")).alias("units"))
    marks = stash(marks.alias("m").join(copies.alias("c"), _same_document("m", "c"), "left_anti"), "marks")
    bitmap = key_bitmap(marks, "text_key")
    likely = keyed.join(F.broadcast(bitmap), bitmap_bucket(F.col("text_key")) == F.col("bucket")).where(bitmap_may_hold(F.col("bits"), F.col("text_key")))
    texts = likely.select("doc_id", "text_key", "text").alias("d").join(marks.alias("m"), _same_document("d", "m"))
    return stash(texts.select("d.doc_id", "d.text_key", "d.text", "m.units"), "texts")


def _firsts(rows: DataFrame, several: Column) -> DataFrame:
    """(hash, check, first) of the hashes that rows share, or that have ``several`` places in one; written, so that a join with it is a plain one, whose hot hashes adaptive execution can split."""
    ends = rows.groupBy("hash", "check").agg(F.min(F.struct("doc_id", "text_key", "at", "start")).alias("first"), (F.count("*") + F.count(several)).alias("n_places"))
    return stash(ends.where(F.col("n_places") > 1).drop("n_places"), "firsts")


def _later(at: Column, least: int) -> Column:
    """Whether a place is not the first itself and does not overlap with it."""
    own = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    return ~own | (at - F.col("first.at") >= least)


def _repeated_stretches(texts: DataFrame, least: int) -> DataFrame:
    """Stretches that stand earlier too: doc_id, text_key, at, start, end, n and first."""
    id_type = texts.schema["doc_id"].dataType.simpleString()
    rows = stash(map_batches(texts, _stretch_function(least), f"doc_id {id_type}, text_key long, hash long, check int, at int, start int, end int, n int"), "stretches")
    joined = rows.join(_firsts(rows, F.lit(None)), ["hash", "check"])
    # a stretch is as long as its windows reach, so it must be clear of the first by all of them
    return stash(joined.where(_later(F.col("at"), least)).select("doc_id", "text_key", "at", "start", "end", "n", "first"), "covered")


def _repeated_windows(texts: DataFrame, covered: DataFrame, pieces: DataFrame, copies: DataFrame, least: int) -> DataFrame:
    """Windows that stand earlier too, but those of ``covered`` stretches: doc_id, text_key, at, start, end, first and opens."""
    lows = stash(covered.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("lows")), "lows")
    asked = texts.alias("t").join(lows.alias("l"), _same_document("t", "l"), "left").select("t.doc_id", "t.text_key", "t.text", "t.units", "l.lows")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    found = map_batches(asked, _window_function(least), f"doc_id {id_type}, text_key long, {_WINDOW_SCHEMA}, opens boolean")
    bare = pieces.where(F.col("unit").isNull()).select("doc_id", "text_key", *_NUMBERS, "more", F.lit(False).alias("opens")).alias("w").join(copies.alias("c"), _same_document("w", "c"), "left_anti")
    rows = stash(found.unionByName(bare), "windows")
    # the places of a row: its own and the triples of its others
    nth = lambda i, k: F.get("more", 3 * i + k)
    others = F.transform(F.sequence(F.lit(0), (F.size("more") / 3).cast("int") - 1), lambda i: F.struct(nth(i, 0).alias("at"), nth(i, 1).alias("start"), nth(i, 2).alias("end")))
    every = F.concat(F.array(F.struct("at", "start", "end")), F.when(F.col("more").isNotNull(), others).otherwise(F.array().cast("array<struct<at:int,start:int,end:int>>")))
    joined = rows.join(_firsts(rows, F.col("more")), ["hash", "check"]).select("doc_id", "text_key", "first", "opens", F.explode(every).alias("p"))
    return stash(joined.where(_later(F.col("p.at"), least)).select("doc_id", "text_key", "p.at", "p.start", "p.end", "first", "opens"), "again")


def repeated_runs(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs to remove: id, text_key, start, end, words, first_doc_id and first_start (where the run's first window occurs first)."""
    if least_words < 2:
        raise ValueError("a passage has two words at least")
    id_type, keyed = docs.schema[id_col].dataType.simpleString(), _keyed(docs, id_col, text_col)
    pieces = stash(map_batches(keyed, _piece_function(least_words), f"doc_id {id_type}, text_key long, whole binary, unit int, {_WINDOW_SCHEMA}"), "pieces")
    copies = stash(_copies(pieces), "copies")
    texts = _marked_texts(pieces, copies, keyed, least_words)
    covered = _repeated_stretches(texts, least_words)
    again = _repeated_windows(texts, covered, pieces, copies, least_words)
    both = again.select("doc_id", "text_key", "at", "start", "end", F.lit(1).alias("n"), "first").unionByName(covered.select("doc_id", "text_key", "at", "start", "end", "n", "first"))
    reach = F.col("at") + F.col("n") - 1 + least_words
    w = Window.partitionBy("doc_id", "text_key").orderBy("at")
    opens = F.coalesce(F.col("at") > F.max(reach).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("int")
    numbered = both.withColumn("opens", opens).withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    words = (F.max(reach) - F.min("at")).cast("int")
    runs = numbered.groupBy("doc_id", "text_key", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), words.alias("words"), F.min_by("first", "at").alias("first"))
    # where a run opens with a stretch, the stretch's first window may itself stand earlier still
    earlier = again.where("opens").select(F.struct("doc_id", "text_key", "at").alias("place"), F.col("first").alias("earliest")).distinct()
    place = F.struct("first.doc_id", "first.text_key", "first.at")
    runs = runs.alias("r").join(earlier.alias("e"), place.eqNullSafe(F.col("e.place")), "left").select("r.*", F.coalesce("e.earliest", "r.first").alias("f"))
    every = runs.select("doc_id", "text_key", "start", "end", "words", F.col("f.doc_id").alias("first_doc_id"), F.col("f.start").alias("first_start")).unionByName(copies)
    return every.withColumnRenamed("doc_id", id_col)


def without_repeats(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the runs of ``removed`` (id, text_key, start, end), and the white space behind each, taken out of the text; every row and column stays."""
    spans_ = removed.groupBy(F.col(id_col).alias("removed_id"), F.col("text_key").alias("removed_key")).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("s.removed_id")) & (F.xxhash64(F.col(f"d.`{text_col}`")) == F.col("s.removed_key"))
    joined = docs.alias("d").join(spans_.alias("s"), same, "left")
    text = F.col(f"d.`{text_col}`")
    ordered = F.array_sort("s.spans")
    # what stays lies between the spans: from behind one to the start of the next
    head = F.substr(text, F.lit(1), F.get(ordered, F.lit(0))["start"])
    tails = F.transform(ordered, lambda s, i: F.regexp_replace(F.substr(text, s["end"] + 1, F.coalesce(F.get(ordered, i + 1)["start"], F.length(text)) - s["end"]), r"^[\x20\x09-\x0D]+", ""))
    cut = F.when(F.col("s.spans").isNull(), text).otherwise(F.concat(head, F.array_join(tails, "")))
    return joined.select(*[cut.alias(c) if c == text_col else F.col(f"d.`{c}`") for c in docs.columns])
