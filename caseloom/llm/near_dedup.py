"""Near-duplicate detection with an LSH forest over MinHash signatures.

A document's set holds the hashes of its distinct five-word shingles. Documents
with equal sets form a class, of which one row goes on. Each class has one
signature; the forest holds it in several orders, each starting at other values.
All orders are sorted as one table, dealt by range. Neighbours in an order are
candidates, since no other row shares a longer prefix with either; they go as deep
as their region is dense. Each class gives a pair an order at most, however
crowded its region is. Candidates whose sizes cannot be alike enough are left out,
the others are confirmed on their full sets.

Neighbours alone would lose links of a crowded region, so it is then finished
exactly. A region holds the classes that share the least depth in some order; it
goes on if it has pairs that are no neighbours and several components meet in it.
Its hub is a set, of the shingles that most of a few of its members hold, and every
member is described by where it differs from that. Members that are linked whatever
they differ in are all linked with the one that is nearest to the hub. Any other two
are linked only if they share so many differences that one of the first must be
common, in an order from rare to common (a prefix filter, with the bound of what may
still follow). Members of near copies differ from what they have in common by edits of
their own, so that hardly any pair is left. A difference that many members share marks
a crowd inside the region: it gets a hub of its own in the next level, where what the
crowd has in common is no difference any more. So a level's work is in proportion to
the members, and no difference pairs more of them than a small number. What remains
is confirmed on full sets too. So no link is lost but one whose ends share the least
depth in no order: one in a million at a similarity of 0.75, fewer above. The result
does not depend on the partitions.

Nulls and odd input: a document without words has an empty set and is a component
of its own, as is one with a null text; a null id gets a null component; repeated
rows share a component; an empty table gives an empty result; columns other than
id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_ROWS, WordHashes, bitmap_bucket, bitmap_may_hold, common_size, finalise, hashed_words, key_bitmap, map_batches, shingle_set, stash
from .components import connected_components

SIGNATURE = 64
ORDERS = 36
#: Signature values that a row of an order holds, and how many of the first a region shares.
DEPTH = 6
LEAST_DEPTH = 4
#: Percent of the union that two sets must share.
LINK_PERCENT = 75
#: Sets of sizes a and b that differ in d values are linked if SAME * (a + b) >= BOTH * d.
SAME, BOTH = 100 - LINK_PERCENT, 100 + LINK_PERCENT

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(1, 1 << 63, SIGNATURE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SIGNATURE, dtype=np.uint64)
_BLOCK = 4096

#: Buckets of the shingle counts that set the order from rare to common: a fixed size, so that workers can hold it.
COUNT_BUCKETS = 1 << 21

#: Members that a difference may pair; more of them get a hub of their own, in so many levels. What is crowded even in the last is paired all the same.
CROWD, LEVELS = 512, 2
#: Members whose common shingles make a hub.
HUB_MEMBERS = 9


def _order_values() -> list[list[int]]:
    """The signature values of each order: blocks of the values in their own and in shuffled sequences, so that orders share hardly any of the least depth."""
    shuffle = np.random.default_rng(5)
    values: list[list[int]] = []
    sequence = np.arange(SIGNATURE)
    while len(values) < ORDERS:
        values += [[int(sequence[(at + i) % SIGNATURE]) for i in range(DEPTH)] for at in range(0, SIGNATURE, LEAST_DEPTH)]
        sequence = shuffle.permutation(SIGNATURE)
    return values[:ORDERS]


ORDER_VALUES = _order_values()


def signature(shingles: np.ndarray) -> bytes:
    """MinHash values of a set, as big-endian 32-bit numbers, so that bytes sort as values do."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _BLOCK):
        np.minimum(least, (shingles[at : at + _BLOCK, None] * _MULTIPLY + _ADD).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(">u4").tobytes()


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            sizes, keys, signatures = [], [], []
            for text in part.column("text").to_pylist():
                shingles = shingle_set(hashed_words(text, cache))
                sizes.append(len(shingles))
                keys.append(xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None)
                signatures.append(signature(shingles) if len(shingles) else None)
            columns = [part.column("doc_id"), part.column("text_key"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "n_shingles", "set_key", "signature"])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).cast("binary").alias("text"))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: set size, set key (equal for equal sets) and signature."""
    id_type = docs.schema[id_col].dataType.simpleString()
    return map_batches(_keyed(docs, id_col, text_col), _fingerprint_batches, f"doc_id {id_type}, text_key long, n_shingles long, set_key binary, signature binary")


def _neighbour_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the sorted orders that share the least depth with a neighbour, and the neighbour before; the last row carries over to the next batch.

    A task's first and last row may have such a neighbour in another task, and are given without one.
    """
    width = 4 * LEAST_DEPTH
    names = ["nth", "prefix", "set_key", "before", "fits"]
    kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]

    def given(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    last: tuple | None = None  # (order, label, key, size, whether it was given)
    for batch in batches:
        rows: list[tuple] = []
        for nth, label, key, size in zip(*(batch.column(c).to_pylist() for c in ("nth", "label", "set_key", "n_shingles")), strict=True):
            if last is None:
                rows.append((nth, label[:width], key, None, None))
                last = (nth, label, key, size, True)
                continue
            near = last[0] == nth and last[1][:width] == label[:width]
            if near:
                if not last[4]:
                    rows.append((nth, label[:width], last[2], None, None))
                rows.append((nth, label[:width], key, last[2], 100 * min(size, last[3]) >= LINK_PERCENT * max(size, last[3])))
            last = (nth, label, key, size, near)
        if rows:
            yield given(rows)
    if last is not None and not last[4]:
        yield given([(last[0], last[1][:width], last[2], None, None)])


def neighbours(classes: DataFrame) -> DataFrame:
    """(nth, prefix, set_key, before, fits): rows of the forest in regions of the least depth, each with the class before it and whether the sizes of the two may belong to a link."""
    labels = [F.concat(*[F.substring("signature", 4 * v + 1, 4) for v in values]) for values in ORDER_VALUES]
    orders = classes.select("set_key", "n_shingles", F.posexplode(F.array(*labels)).alias("nth", "label"))
    order = ["nth", "label", "set_key"]
    return map_batches(orders.repartitionByRange(*order).sortWithinPartitions(*order), _neighbour_batches, "nth int, prefix binary, set_key binary, before binary, fits boolean")


def candidates(near: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of neighbours of any order whose sizes may belong to a link."""
    pairs = near.where("fits")
    return pairs.select(F.least("set_key", "before").alias("a"), F.greatest("set_key", "before").alias("b")).distinct()


def texts_of(nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(set_key, text) of the classes in ``nodes`` (set_key, doc_id, text_key).

    Documents pass a bitmap of the wanted keys first; the bitmap's size is fixed,
    so it can be broadcast at any scale, and only wanted texts are shuffled.
    """
    bitmap = key_bitmap(nodes, "text_key")
    keyed = _keyed(docs, id_col, text_col)
    wanted = keyed.join(F.broadcast(bitmap), bitmap_bucket(F.col("text_key")) == F.col("bucket")).where(bitmap_may_hold(F.col("bits"), F.col("text_key")))
    wanted = wanted.select("doc_id", "text_key", "text").alias("d")
    found = wanted.join(nodes.alias("n"), F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("d.text_key") == F.col("n.text_key")))
    return found.select("n.set_key", "d.text").dropDuplicates(["set_key"])


def _confirm_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    last: tuple[bytes | None, np.ndarray] = (None, np.empty(0, np.uint64))
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(at, SLICE_ROWS)
            a, b, linked = part.column("a").to_pylist(), part.column("b").to_pylist(), []
            for node, one, other in zip(b, part.column("left").to_pylist(), part.column("right").to_pylist(), strict=True):
                if last[0] != node:
                    last = (node, shingle_set(hashed_words(other, cache)))
                first, second = shingle_set(hashed_words(one, cache)), last[1]
                both = common_size(first, second)
                linked.append(100 * both >= LINK_PERCENT * (len(first) + len(second) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"]).filter(pa.array(linked, pa.bool_()))


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(texts.withColumnsRenamed({"set_key": "a", "text": "left"}), "a").join(texts.withColumnsRenamed({"set_key": "b", "text": "right"}), "b")
    return map_batches(both.select("a", "b", "left", "right"), _confirm_batches, "a binary, b binary")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))


def _confirm_all(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links among candidate pairs."""
    pairs = stash(pairs, "candidates")
    ends = _ends(pairs).distinct().select(F.col("node").alias("set_key"))
    nodes = stash(classes.join(ends, "set_key").select("set_key", "doc_id", "text_key"), "nodes")
    texts = stash(texts_of(nodes, docs, id_col, text_col), "texts")
    return stash(confirmed(pairs, texts), "links")


def spokes_of(members: DataFrame, place: list[str]) -> DataFrame:
    """(set_key, root, hub): members (place, set_key, root, n) with each hub they are compared with.

    A hub is named by the member that meets most rows in all its places, so that
    the places of one crowd have the same hub.
    """
    weights = stash(members.groupBy("set_key").agg(F.sum("n").alias("weight")), "weights")
    hubs = stash(members.join(weights, "set_key").groupBy(*place).agg(F.max_by("set_key", F.struct("weight", "set_key")).alias("hub")), "hubs")
    return members.join(hubs, place).select("set_key", "root", "hub").distinct()


def region_members(near: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the regions in which several components meet and some pair is no pair of neighbours, with their hubs."""
    place = ["nth", "prefix"]
    rows = near.join(roots.select(F.col("node").alias("set_key"), "root"), "set_key", "left")
    rows = stash(rows.select(*place, "set_key", "before", F.coalesce("root", "set_key").alias("root")), "regions")
    met = rows.groupBy(*place).agg(F.count("*").alias("n"), F.count("before").alias("pairs"), F.min("root").alias("least"), F.max("root").alias("most"))
    met = met.where((F.col("least") != F.col("most")) & ((F.col("n") > 2) | (F.col("pairs") < 1))).select(*place, "n")
    return spokes_of(stash(rows.drop("before").join(stash(met, "met"), place), "members"), place)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles per bucket, over a whole task."""
    cache, counts = WordHashes(), np.zeros(COUNT_BUCKETS, np.int64)
    for batch in batches:
        for text in batch.column("text"):
            np.add.at(counts, (shingle_set(hashed_words(text.as_py(), cache)) % np.uint64(COUNT_BUCKETS)).astype(np.int64), 1)
    held = np.flatnonzero(counts)
    for at in range(0, len(held), 1 << 16):
        part = held[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(counts[part], pa.int64())], ["bucket", "n"])


def shingle_counts(texts: DataFrame) -> np.ndarray:
    """How many texts hold a shingle of each bucket: a table of fixed size."""
    counted = map_batches(texts.select("text"), _count_batches, "bucket long, n long").groupBy("bucket").agg(F.least(F.sum("n"), F.lit((1 << 31) - 1)).cast("int").alias("n")).toArrow()
    counts = np.zeros(COUNT_BUCKETS, np.int32)
    counts[np.asarray(counted.column("bucket"))] = np.asarray(counted.column("n"))
    return counts


def _hub_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        sets = []
        for texts in batch.column("texts"):
            held = [shingle_set(hashed_words(t.as_py(), cache)) for t in texts.values]
            values, n = np.unique(np.concatenate(held), return_counts=True)
            sets.append(values[2 * n > len(held)].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("hub"), pa.array(sets, pa.binary())], ["hub", "shingles"])


def hub_sets(spokes: DataFrame, texts: DataFrame) -> DataFrame:
    """(hub, shingles): what most of the first members of each hub hold, by a hash of their keys. Any set would give the same links, a near one gives less work."""
    first = F.row_number().over(Window.partitionBy("hub").orderBy(F.xxhash64("set_key"), "set_key"))
    chosen = spokes.select("hub", "set_key").withColumn("nth", first).where(F.col("nth") <= HUB_MEMBERS)
    return map_batches(chosen.join(texts, "set_key").groupBy("hub").agg(F.collect_list("text").alias("texts")), _hub_batches, "hub binary, shingles binary")


def lookups(differences: int, size: int, hub_size: int) -> int:
    """How many of a member's first differences must be looked up to meet every partner.

    The fewer differences a partner has, the fewer must be shared; the fewest are
    those of one as unlike the member as a linked one can be. Partners that need
    share none are linked with the member nearest to the hub, as this one is.
    """
    largest = 100 * size // LINK_PERCENT
    least = max(0, differences - SAME * (size + largest) // BOTH)
    shared = -(-(BOTH * (differences + least) - SAME * (size + min(largest, hub_size + least))) // (2 * BOTH))
    return differences - max(1, shared) + 1


#: One row a difference to look up, and one with a null place for each member.
_SPOKE_SCHEMA = "place long, set_key binary, root binary, hub binary, slack int, own_left int, gone_left int, differences int, size int"


def _spoke_function(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, counts = WordHashes(), shared.value
        often = lambda x: counts[(x % np.uint64(COUNT_BUCKETS)).astype(np.int64)]
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                numbers, owners, slack = [], [], []
                rows = list(zip(*(part.column(c).to_pylist() for c in ("hub", "text", "shingles")), strict=True))
                for nth, (hub, text, held) in enumerate(rows):
                    mine, theirs = shingle_set(hashed_words(text, cache)), np.frombuffer(held, np.uint64)
                    own, gone = np.setdiff1d(mine, theirs, assume_unique=True), np.setdiff1d(theirs, mine, assume_unique=True)
                    differences = len(own) + len(gone)
                    slack.append(SAME * len(mine) - BOTH * differences)
                    own_often, gone_often = often(own), often(gone)
                    alone = int((own_often < 2).sum())  # a shingle of one text leads to no other
                    order = np.concatenate([own[np.lexsort((own, own_often))], gone[np.lexsort((gone, -gone_often))]])
                    at = np.arange(alone, lookups(differences, len(mine), len(theirs)))
                    if not len(at):
                        continue
                    place = finalise(order[at] ^ np.uint64(int.from_bytes(hub[:8], "big")))
                    left = np.maximum(len(own) - at, 0), np.minimum(len(gone), differences - at)
                    numbers.append(np.column_stack([place.view(np.int64), *left, np.full(len(at), differences), np.full(len(at), len(mine))]))
                    owners.append(np.full(len(at), nth))
                table = np.concatenate(numbers) if numbers else np.empty((0, 5), np.int64)
                whose = np.concatenate([*owners, np.arange(len(rows))]).astype(np.int64)
                bare = lambda column, kind: pa.concat_arrays([pa.array(column).cast(kind), pa.nulls(len(rows), kind)])
                names = [part.column(c).take(pa.array(whose)) for c in ("set_key", "root", "hub")]
                columns = [bare(table[:, 0], pa.int64()), *names, pa.array(np.array(slack, np.int32)[whose]), *(bare(table[:, i], pa.int32()) for i in (1, 2, 3, 4))]
                yield pa.RecordBatch.from_arrays(columns, ["place", "set_key", "root", "hub", "slack", "own_left", "gone_left", "differences", "size"])

    return run


def compared_with_hubs(spokes: DataFrame, texts: DataFrame, hubs: DataFrame, shared) -> DataFrame:
    """Members with their slack (place is null), and their differences to look up."""
    both = spokes.join(texts, "set_key").join(hubs, "hub")
    return map_batches(both.select("set_key", "root", "hub", "text", "shingles"), _spoke_function(shared), _SPOKE_SCHEMA)


def difference_pairs(rows: DataFrame, places: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of different components that share a difference, at one of these places, and may share enough."""
    met = stash(rows.join(places, "place"), "paired")
    side = lambda name: met.select("place", F.struct("set_key", "root", "meets", "own_left", "gone_left", "differences", "size").alias(name))
    l, r = F.col("l"), F.col("r")
    may_share = F.least(l["own_left"], r["own_left"]) + F.least(l["gone_left"], r["gone_left"])
    enough = may_share * (2 * BOTH) >= (l["differences"] + r["differences"]) * BOTH - (l["size"] + r["size"]) * SAME
    sizes = (l["size"] * 100 >= r["size"] * LINK_PERCENT) & (r["size"] * 100 >= l["size"] * LINK_PERCENT)
    apart = (l["root"] != r["root"]) & (l["meets"] != r["meets"])
    pairs = side("l").join(side("r"), "place").where((l["set_key"] < r["set_key"]) & apart & sizes & enough)
    return pairs.select(l["set_key"].alias("a"), r["set_key"].alias("b")).distinct()


def finished(spokes: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, candidate pairs) of regions, level by level: what is crowded in one is compared with hubs of its own in the next.

    Two members whose slacks make no less than nothing together are linked even if
    they share no difference; then each is so with the member of the most slack.
    """
    shared = texts.sparkSession.sparkContext.broadcast(shingle_counts(texts))
    links = pairs = None
    for level in range(1, LEVELS + 1):
        hubs = stash(hub_sets(spokes, texts), "hubs")
        rows = stash(compared_with_hubs(spokes, texts, hubs, shared), "differences")
        members = rows.where(F.col("place").isNull()).select("set_key", "hub", "slack", "root")
        nearest = members.groupBy("hub").agg(F.max_by(F.struct("set_key", "root", "slack"), F.struct("slack", "set_key")).alias("nearest"))
        nearest = stash(nearest, "nearest")
        near = F.col("slack") + F.col("nearest.slack") >= 0
        linked = members.join(nearest, "hub").where(near & (F.col("set_key") != F.col("nearest.set_key"))).select(F.col("set_key").alias("a"), F.col("nearest.set_key").alias("b"))
        looked = rows.where(F.col("place").isNotNull()).join(nearest, "hub").withColumn("meets", F.when(near, F.col("nearest.root")).otherwise(F.col("root"))).drop("hub", "slack", "nearest")
        ends = looked.groupBy("place").agg(F.count("*").alias("n"), F.min("meets").alias("least"), F.max("meets").alias("most"))
        several = stash(ends.where(F.col("least") != F.col("most")).select("place", "n"), "several")
        crowded = several.where(F.col("n") > CROWD)
        last = level == LEVELS or crowded.isEmpty()
        found = stash(difference_pairs(looked, (several if last else several.where(F.col("n") <= CROWD)).select("place")), "pairs")
        links, pairs = (linked, found) if links is None else (links.union(linked), pairs.union(found))
        if last:
            break
        crowd = looked.select("place", "set_key", "root").join(crowded, "place")
        spokes = stash(spokes_of(stash(crowd, "members"), ["place"]), "spokes")
    shared.destroy()
    return stash(links.distinct(), "linked"), pairs.distinct()


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of the components ``roots`` with further links between their nodes or others."""
    over = links
    for side in ("a", "b"):
        over = over.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    more = connected_components(over.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    moved = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
    return moved.select("node", F.coalesce("top", "root").alias("root")).union(more)


def link(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, root) over the classes that are linked with others."""
    near = stash(neighbours(classes), "neighbours")
    links = _confirm_all(candidates(near), classes, docs, id_col, text_col)
    roots = connected_components(links)
    spokes = stash(region_members(near, roots), "spokes")
    keys = spokes.select("set_key").distinct()
    nodes = stash(classes.join(keys, "set_key").select("set_key", "doc_id", "text_key"), "nodes")
    texts = stash(texts_of(nodes, docs, id_col, text_col), "texts")
    hubs, pairs = finished(spokes, texts)
    more = stash(confirmed(pairs, texts), "links")
    return _joined(roots, hubs.union(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, text_key, n_shingles, component_id (least id of its component) and kept (whether it has that id)."""
    prints = stash(fingerprints(docs, id_col, text_col), "fingerprints")
    classes = prints.where(F.col("set_key").isNotNull()).groupBy("set_key")
    classes = stash(classes.agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_key", "signature", "n_shingles")).alias("one"), F.count("*").alias("copies")).select("set_key", "least_id", "one.doc_id", "one.text_key", "one.signature", "one.n_shingles", "copies"), "classes")
    roots = link(classes, docs, id_col, text_col)
    grouped = classes.join(roots, classes["set_key"] == roots["node"], "left").select("set_key", "least_id", "copies", F.coalesce("root", "set_key").alias("root"))
    least = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"), F.sum("copies").alias("together"))
    # written first, so that the join is a plain one, whose hot component adaptive execution can split
    least = stash(least.where(F.col("together") > 1), "components")
    members = grouped.join(least, "root").select("set_key", "component_id")
    joined = prints.select("doc_id", "text_key", "n_shingles", "set_key").join(members, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    result = joined.select(F.col("doc_id").alias(id_col), "text_key", "n_shingles", component.alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))
