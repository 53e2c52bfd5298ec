"""Coverage and discrimination: requirements, the checks mapped to them, and runs that trip checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import share


def compare_maps(required: DataFrame, mapped: DataFrame, key: str, kind: str) -> DataFrame:
    """Full comparison: keys with ``unknown`` (mapped only), ``missing`` (required only) or ``type_mismatch``."""
    r = required.select(key, F.col(kind).alias("required_kind"), F.lit(True).alias("is_required"))
    m = mapped.select(key, F.col(kind).alias("mapped_kind"), F.lit(True).alias("is_mapped"))
    both = r.join(m, key, "full_outer")
    issue = F.when(F.col("is_required").isNull(), "unknown").when(F.col("is_mapped").isNull(), "missing").when(~F.col("required_kind").eqNullSafe(F.col("mapped_kind")), "type_mismatch")
    return both.withColumn("issue", issue).where(F.col("issue").isNotNull()).select(key, "issue")


def coverage(required: DataFrame, mapped: DataFrame, group: list[str], key: str) -> DataFrame:
    """Distinct required keys of each group, those that are mapped, and their share (0 for none)."""
    marked = required.select(*group, key).distinct().join(mapped.select(key).distinct().withColumn("hit", F.lit(True)), key, "left")
    counted = marked.groupBy(*group).agg(F.count("*").alias("required"), F.count_if(F.col("hit")).alias("covered"))
    return counted.withColumn("coverage", F.round(share(F.col("covered"), F.col("required")), 9))


def discrimination(checks: DataFrame, runs: DataFrame, group: list[str], key: str) -> DataFrame:
    """Per mapped check of a group: runs that target it, runs of those that it caught, runs of any target in which it fired, and where that falls short.

    ``runs`` has a row per mutant run: the group, the check it targets (``key``),
    the names of all checks that ``failed`` in it, and whether it ``broke``. A
    broken run targets and fires, but catches nothing; runs whose target is not
    mapped count for nothing. ``dead`` never fired, ``uncovered`` caught nothing,
    ``untested`` was never targeted; a check may be dead and uncovered at once.
    """
    on = [*group, key]
    mapped = checks.select(*on).distinct()
    own = runs.join(mapped, on, "left_semi")
    hit = ~F.col("broke") & F.array_contains("failed", F.col(key))
    seen = own.groupBy(*on).agg(F.count("*").alias("targeting"), F.count_if(hit).alias("detected"))
    fired = own.select(*group, F.explode(F.array_distinct("failed")).alias(key)).groupBy(*on).agg(F.count("*").alias("activation"))
    out = mapped.join(seen, on, "left").join(fired, on, "left").na.fill(0, ["targeting", "detected", "activation"])
    targeted = F.col("targeting") > 0
    return out.withColumns({"covered": F.col("detected") > 0, "dead": targeted & (F.col("activation") == 0), "uncovered": targeted & (F.col("detected") == 0), "untested": ~targeted})


def problem_checks(states: DataFrame, group: list[str], key: str) -> DataFrame:
    """The checks of each group that are uncovered, dead or untested."""
    return states.where(F.col("uncovered") | F.col("dead") | F.col("untested")).select(*group, key).distinct()


def discrimination_coverage(states: DataFrame, group: list[str]) -> DataFrame:
    """Share of each group's mapped checks that are covered."""
    return states.groupBy(*group).agg(F.round(F.avg(F.col("covered").cast("int")), 3).alias("discrimination_coverage"))


def static_score(mutants: DataFrame, mapped: DataFrame, group: list[str], key: str) -> DataFrame:
    """Share of each group's mutants whose target is mapped at all: the score where none was run."""
    known = mutants.join(mapped.select(*group, key).distinct().withColumn("hit", F.lit(True)), [*group, key], "left")
    return known.groupBy(*group).agg(F.round(F.count_if(F.col("hit")) / F.count("*"), 3).alias("static_score"))


def kill_score(runs: DataFrame, group: list[str]) -> DataFrame:
    """Kills per valid run; broken runs are left out, no valid run gives 0."""
    valid = ~F.col("broke")
    out = runs.groupBy(*group).agg(F.count_if(valid).alias("valid_runs"), F.count_if(valid & F.col("caught")).alias("kills"), F.count_if(F.col("broke")).alias("broken"))
    return out.withColumn("score", F.round(share(F.col("kills"), F.col("valid_runs")), 9))


def recall_at_least(scores: DataFrame, least: int) -> DataFrame:
    """``set_scores`` rows with whether at least so many true keys were found."""
    return scores.withColumn("reaches", F.col("n_both") >= least)


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, without empty ones."""
    given = rows
    for c in key:
        given = given.where(F.coalesce(F.col(c).cast("string"), F.lit("")) != "")
    return given.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def set_scores(truth: DataFrame, found: DataFrame, group: list[str], key: list[str], ignore_case: bool = False) -> DataFrame:
    """Precision, recall and F1 of distinct found against true keys; zero denominators give 0. Also the recall that counts an empty truth as 1, and the share of false finds. Graders of names compare them with ``ignore_case``."""
    on = [*group, *key]
    if ignore_case:
        truth, found = (side.withColumns({k: F.lower(k) for k in key}) for side in (truth, found))
    both = truth.select(*on).distinct().withColumn("t", F.lit(1)).join(found.select(*on).distinct().withColumn("f", F.lit(1)), on, "full_outer")
    n = both.groupBy(*group).agg(F.count("t").alias("n_true"), F.count("f").alias("n_found"), F.count_if(F.col("t").isNotNull() & F.col("f").isNotNull()).alias("n_both"))
    p, r = share(F.col("n_both"), F.col("n_found")), share(F.col("n_both"), F.col("n_true"))
    f1 = F.when(p + r > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0)
    values: dict[str, Column] = {"precision": p, "recall": r, "f1": f1, "recall_or_one": share(F.col("n_both"), F.col("n_true"), 1.0), "false_share": share(F.col("n_found") - F.col("n_both"), F.col("n_found"))}
    return n.withColumns({k: F.round(v, 9) for k, v in values.items()})
