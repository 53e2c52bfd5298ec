"""Connected components of an edge table, with distributed star contractions.

Alternates large stars and small stars (Kiveris et al., "Connected Components in
MapReduce and Beyond") until the edges are stars around each component's least
node. Every step is a grouped minimum and a join; no component is ever gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash


def _contracted(pairs: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none: the edges are stars then, and no two of them touch."""
    forked = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("a")
    inner = pairs.join(pairs.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select("a")
    return forked.union(inner).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots, root being the least node of the component.

    Loops and repeated edges are allowed and nulls are not links; no edges give no rows.
    """
    pairs = edges.where(F.col("a") != F.col("b"))
    pairs = stash(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _contracted(pairs):
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = stash(least, "least")  # summed before the shuffle, and joined plainly, so that a hub's edges can be split
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stash(large, "large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        pairs = stash(small, "small")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
