"""Choosing records: membership, grades, resume, latest row, seeded sample, scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.scratch import stored


def members(cases: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Cases that are wanted, and wanted keys that no case has."""
    return cases.join(wanted, key, "left_semi"), wanted.join(cases, key, "left_anti")


def graded(cases: DataFrame, grades: DataFrame, key: str, usable: list[str]) -> DataFrame:
    """``cases`` with their upper-cased grade (empty if there is none), usable and ungraded."""
    grade = F.upper(F.coalesce("grade", F.lit("")))
    joined = cases.join(grades.select(key, "grade"), key, "left").withColumn("grade", grade)
    return joined.withColumns({"usable": F.col("grade").isin(usable), "ungraded": F.col("grade") == ""})


def pending(cases: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Cases without a result yet."""
    return cases.join(results.select(key), key, "left_anti")


def latest(rows: DataFrame, key: list[str], sequence: list[str]) -> DataFrame:
    """The last row of each key. One grouped maximum, so no key is sorted whole."""
    rest = [c for c in rows.columns if c not in key]
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*sequence)).alias("last"))
    return best.select(*key, *[F.col(f"last.{c}").alias(c) for c in rest])


def seeded_sample(rows: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """The first ``n`` rows in the order of a digest of seed and key: reproducible on any cluster."""
    if n < 0:
        raise ValueError("n must not be negative")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    return rows.withColumn("sample_order", order).orderBy("sample_order", key).limit(n)


def near_best(rows: DataFrame, group: list[str], score: Column, floor: float, slack: float) -> DataFrame:
    """Rows whose score is at least ``floor`` and within ``slack`` of their group's best."""
    scored = rows.withColumn("score", score)
    best = scored.groupBy(*group).agg(F.max("score").alias("best"))
    return scored.join(best, group).where(F.col("score") >= F.greatest(F.lit(floor), F.col("best") - slack)).drop("best")


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their place in a total order, from 1: sorted by range, counted per range and moved on by the ranges before, so that no task sees all rows."""
    dealt = stored(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()))
    counts = dealt.groupBy("range").agg(F.count("*").alias("n"))  # a row per range
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    placed = dealt.withColumn("nth", F.row_number().over(Window.partitionBy("range").orderBy(*order)))
    return placed.join(F.broadcast(before), "range").withColumn("rank", (F.col("nth") + F.col("before")).cast("long")).drop("range", "nth", "before")


def ranked_within(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with their place in their group, from 1, and ``n``, the group's rows. A group may be all rows: none is sorted or gathered by one task."""
    placed = stored(ranked(rows, [*group, *order]))
    starts = placed.groupBy(*group).agg(F.min("rank").alias("first"), F.count("*").alias("n")).alias("g")
    same = reduce(lambda a, b: a & b, [F.col(f"p.{c}").eqNullSafe(F.col(f"g.{c}")) for c in group])
    rank = (F.col("p.rank") - F.col("g.first") + 1).alias("rank")
    return placed.alias("p").join(starts, same).select(*[F.col(f"p.{c}") for c in rows.columns], rank, F.col("g.n").alias("n"))


def order_statistics(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """Exact (n, least, second, median, last_but_one, greatest) of a group's non-null values, picked by rank."""
    placed = ranked_within(rows.where(F.col(value).isNotNull()).select(*group, value), group, [value])
    at = lambda rank: F.max(F.when(F.col("rank") == rank, F.col(value)))
    n = F.col("n")
    low, high = at(F.floor((n + 1) / 2)), at(F.floor(n / 2) + 1)
    return placed.groupBy(*group).agg(
        F.max("n").alias("n"), at(F.lit(1)).alias("least"), at(F.lit(2)).alias("second"), ((low + high) / 2).alias("median"), at(n - 1).alias("last_but_one"), at(n).alias("greatest")
    )


def trimmed_statistics(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """(middle, spread) of a group's values without one least and one greatest, where there are more than two.

    Trimming both ends leaves the median where it is; the spread is what is left
    between the ends, as a share of the lower one.
    """
    found = order_statistics(rows, group, value)
    low = F.when(F.col("n") > 2, F.col("second")).otherwise(F.col("least"))
    high = F.when(F.col("n") > 2, F.col("last_but_one")).otherwise(F.col("greatest"))
    return found.select(*group, F.col("median").alias("middle"), F.try_divide(high - low, low).alias("spread"))


def prune_lowest(rows: DataFrame, score: str, tie: str, share: float) -> DataFrame:
    """Marks the k lowest rows, k being the rounded share of all, at least one and never all."""
    k = rows.agg(F.greatest(F.lit(1), F.least(F.count("*") - 1, F.bround(F.count("*") * share, 0).cast("long"))).alias("k"))
    return ranked(rows, [score, tie]).join(F.broadcast(k)).withColumn("pruned", F.col("rank") <= F.col("k")).drop("k")
