"""Small-graph operators as joins: closures, bounded cones, unused nodes, truth tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut, stored


def closure(starts: DataFrame, edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(start, node, depth) of every node reachable over ``edges`` (src, dst), at its least depth; with ``max_depth`` the cone of so many steps.

    Breadth first: each round joins only the newest frontier and leaves out what
    was seen, so cycles end it and so does the fix point, however deep. A row of the
    frontier is a node with the bits of up to 64 starts that have come to it, so an
    edge is walked once a round for all of them, and one grouping both unites what
    meets at a node and leaves out the bits that it has. Edges, frontiers and seen
    nodes are stored, which keeps the plan short and says how large they are.
    """
    numbered = stored(starts.select("start").distinct().coalesce(1).withColumn("id", F.monotonically_increasing_id()))  # 64 starts a block, however many
    numbered = numbered.select("start", F.shiftright("id", 6).alias("block"), F.expr("shiftleft(1L, CAST(id & 63 AS INT))").alias("bit"))
    edges = stored(edges.select("src", "dst"))
    frontier = stored(numbered.select("block", F.col("start").alias("node"), F.col("bit").alias("mask")))
    seen, depth = frontier.withColumn("depth", F.lit(0)), 0
    while max_depth is None or depth < max_depth:
        depth += 1
        step = frontier.join(edges, frontier["node"] == edges["src"]).select("block", F.col("dst").alias("node"), F.col("mask").alias("new"), F.lit(0).cast("long").alias("old"))
        held = seen.select("block", "node", F.lit(0).cast("long").alias("new"), F.col("mask").alias("old"))
        met = step.union(held).groupBy("block", "node").agg(F.bit_or("new").alias("new"), F.bit_or("old").alias("old"))
        frontier = stored(met.select("block", "node", F.col("new").bitwiseAND(F.bitwise_not("old")).alias("mask")).where(F.col("mask") != 0))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier.withColumn("depth", F.lit(depth)))
        seen = stored(seen) if depth % 8 == 0 else seen
    return seen.join(numbered, "block").where(F.col("mask").bitwiseAND(F.col("bit")) != 0).select("start", "node", "depth")


def reaches(starts: DataFrame, edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(start, reaches): whether any node of ``targets`` (node) can be reached; a start that has reached one is followed no further."""
    wanted, edges = targets.select("node").distinct(), stored(edges.select("src", "dst"))
    seen = starts.select("start", F.col("start").alias("node")).distinct()
    frontier, found = seen, None
    while True:
        hit = cut(frontier.join(wanted, "node", "left_semi").select("start").distinct())
        found = hit if found is None else found.union(hit)
        open_ = frontier.join(hit, "start", "left_anti")
        step = open_.join(edges, open_["node"] == edges["src"]).select("start", F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(seen, ["start", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = cut(seen.union(frontier))
    marked = found.distinct().withColumn("reaches", F.lit(True))
    return starts.select("start").distinct().join(marked, "start", "left").na.fill(False, ["reaches"])


def dependencies(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(start, node, depth) of all that a start depends on, without itself."""
    return closure(starts, edges).where(F.col("node") != F.col("start"))


def first_seen_again(new: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """Keys of ``new`` that another file has too; none where files are disjoint."""
    return new.select(key).distinct().join(others.select(key), key, "left_semi")


def unused(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """Nodes that no edge consumes."""
    return nodes.join(edges.select(key).distinct(), key, "left_anti")


def truth_table(spark, names: list[str]) -> DataFrame:
    """All assignments of a few booleans."""
    row = spark.range(1 << len(names))
    return row.select(*[(F.getbit("id", F.lit(i)) == 1).alias(n) for i, n in enumerate(names)])


def matching_nets(expressions: DataFrame, nets: DataFrame) -> DataFrame:
    """Pairs where an expression names a net as a whole word: expressions are split into words, so this is an equality join."""
    words = expressions.withColumn("net", F.explode(F.array_distinct(F.regexp_extract_all("expression", F.lit(r"[A-Za-z_]\w*"), F.lit(0)))))
    return words.join(nets, "net")


def indexed_nets(expressions: DataFrame, bits: DataFrame) -> DataFrame:
    """Pairs where an expression selects a bit (net, bit) of a net, as in ``net [ 3 ]``; a longer name that ends in the net's selects it too.

    Expressions are read once into postings of word and index. They meet the bits on
    the index and on as many last characters as the shortest net has, an equality
    join whatever the number of nets, and are then held against the whole name.
    """
    shortest = bits.agg(F.min(F.char_length("net"))).first()[0] or 1
    selects = F.array_distinct(F.regexp_extract_all("expression", F.lit(r"(\w+)\s*\[\s*(\d+)\s*\]"), F.lit(0)))
    read = expressions.withColumn("posting", F.explode(selects))
    read = read.withColumns({"word": F.regexp_extract("posting", r"^(\w+)", 1), "index": F.regexp_extract("posting", r"(\d+)\s*\]$", 1)})
    read = read.withColumn("ending", F.right("word", F.lit(shortest)))
    wanted = bits.select("net", "bit", F.col("bit").cast("string").alias("index"), F.right("net", F.lit(shortest)).alias("ending")).distinct()
    met = read.join(wanted, ["index", "ending"]).where(F.endswith("word", F.col("net")))
    return met.select(*expressions.columns, "net", "bit").distinct()


def resolved(entries: DataFrame, cases: DataFrame, id_col: str, key: str, position: str) -> DataFrame:
    """Every entry with its case (struct ``case``): the first by position whose key array has the same members, else the first with its id.

    An entry that neither finds is an error, which the plan raises when it runs.
    """
    found = F.struct(*[F.col(c) for c in cases.columns])
    first = F.min_by(found, F.col(position))
    by_key = cases.groupBy(F.array_sort(key).alias("sorted key")).agg(first.alias("by key"))
    by_id = cases.groupBy(F.col(id_col).alias("case id")).agg(first.alias("by id"))
    joined = entries.withColumn("sorted key", F.array_sort(key)).join(by_key, "sorted key", "left").join(by_id, F.col(id_col) == F.col("case id"), "left")
    failed = F.raise_error(F.concat(F.lit("no case for "), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    case = F.when(F.col("by key").isNotNull(), F.col("by key")).when(F.col("by id").isNotNull(), F.col("by id")).otherwise(failed)
    return joined.select(*entries.columns, case.alias("case"), F.col("by key").isNotNull().alias("by_key"))


def all_of(frames: list[DataFrame], key: str) -> DataFrame:
    """Keys that every frame has."""
    return reduce(lambda a, b: a.intersect(b), [f.select(key) for f in frames])
