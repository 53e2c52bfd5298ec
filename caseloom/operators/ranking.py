"""Order-sensitive operators; every one names its sequence and its tie rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.text import CRASH, SETUP_FAILURE
from ..sources.scratch import stored
from .select import ranked_within


def best_round(rows: DataFrame, group: list[str], rank: list[Column], sequence: str, later_wins: bool = True) -> DataFrame:
    """The row with the greatest rank key of each group; ties go to the later or the earlier of the sequence."""
    rest = [c for c in rows.columns if c not in group]
    tie = F.col(sequence) if later_wins else -F.col(sequence)
    best = rows.groupBy(*group).agg(F.max_by(F.struct(*rest), F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)], tie.alias("tie"))).alias("best"))
    return best.select(*group, *[F.col(f"best.{c}").alias(c) for c in rest])


def until_repeat(rows: DataFrame, group: list[str], sequence: list[str], signature: str, final: Column | None = None) -> DataFrame:
    """Rows of each group up to and with the first whose signature equals the one before, or which is ``final``; ``stopped`` marks it."""
    w = Window.partitionBy(*group).orderBy(*sequence)
    repeats = F.coalesce((F.col(signature) == F.lag(signature).over(w)) & (F.col(signature) != ""), F.lit(False))
    ends = repeats if final is None else repeats | F.coalesce(final, F.lit(False))
    marked = rows.withColumn("repeats", ends.cast("int"))
    earlier = F.coalesce(F.sum("repeats").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("earlier", earlier).where(F.col("earlier") == 0).withColumn("stopped", F.col("repeats") == 1).drop("repeats", "earlier")


#: Failure classes that no retry mends.
NOT_REPAIRABLE = ["submission_invariant", "runner_error"]


def round_rank(r: Column) -> list[Column]:
    """Rank of a repair round (struct of validation_status, differential_status, analyzer_status, baseline_status, mutation_score, mapping_coverage, coverage, discrimination_coverage, n_issues); the greater the better."""
    is_ = lambda c, *of: F.coalesce(r[c].isin(*of), F.lit(False)).cast("int")
    score = lambda *c: F.bround(F.coalesce(*c, F.lit(0.0)), 3)
    return [
        is_("validation_status", "pass"), is_("differential_status", "pass"), is_("analyzer_status", "pass", "warning"), is_("baseline_status", "pass"),
        score(r["mutation_score"]), score(r["mapping_coverage"], r["coverage"]), score(r["discrimination_coverage"]), -F.coalesce(r["n_issues"], F.lit(0)),
    ]


def preflight_rank(golden: Column, vulnerable: Column) -> list[Column]:
    """Rank of a differential run from its golden and vulnerable arm (structs of ok, status, stdout, stderr); the greater the better."""
    text = lambda r: F.concat(F.coalesce(r["stdout"], F.lit("")), F.lit("\n"), F.coalesce(r["stderr"], F.lit("")))
    holds = lambda r, mark: F.contains(text(r), F.lit(mark))
    count = lambda r, mark: F.regexp_count(text(r), F.lit(r"\[TEST\] " + mark + ":"))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    usable = golden["status"].isin("pass", "fail") & ~holds(golden, CRASH) & ~holds(golden, SETUP_FAILURE)
    rejects = (vulnerable["status"] == "fail") & holds(vulnerable, "[TEST] FAIL:") & ~holds(vulnerable, SETUP_FAILURE) & ~holds(vulnerable, CRASH)
    return [flag(golden["ok"]), count(golden, "PASS"), -count(golden, "FAIL"), flag(golden["status"] == "pass"), flag(usable), flag(vulnerable["ok"]), flag(rejects)]


def within_budget(rows: DataFrame, group: list[str], sequence: list[str], cost: Column, budget: int, calls: int) -> DataFrame:
    """Rows that start before their group has spent its budget or its number of calls."""
    w = Window.partitionBy(*group).orderBy(*sequence)
    spent = F.coalesce(F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumns({"spent_before": spent.cast("long"), "calls_before": (F.row_number().over(w) - 1).cast("long")})
    return out.where((F.col("spent_before") < budget) & (F.col("calls_before") < calls))


def running_totals(rows: DataFrame, group: list[str], sequence: list[str], columns: list[str]) -> DataFrame:
    w = Window.partitionBy(*group).orderBy(*sequence).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({f"running_{c}": F.sum(c).over(w) for c in columns} | {"running_calls": F.count("*").over(w)})


def majority(rows: DataFrame, group: list[str], value: str, sequence: str) -> DataFrame:
    """The commonest non-null value of each group; ties go to the one seen first."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count("*").alias("votes"), F.min(sequence).alias("first_seen"))
    best = counted.groupBy(*group).agg(F.max_by(F.struct(value, "votes"), F.struct("votes", -F.col("first_seen"))).alias("b"))
    return best.select(*group, f"b.{value}", "b.votes")


def greatest_rows(rows: DataFrame, group: list[str], score: str) -> DataFrame:
    """Every row that ties for its group's greatest score."""
    best = rows.groupBy(*group).agg(F.max(score).alias("best"))
    return rows.join(best, group).where(F.col(score) == F.col("best")).drop("best")


def step_distance(rows: DataFrame, group: list[str], sequence: list[str], value: str, bits: int) -> DataFrame:
    """Bits that change from one sample to the next; the first of a group has none."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(*sequence))
    return rows.withColumn("distance", F.bit_count(F.col(value).bitwiseXOR(before).bitwiseAND(F.lit((1 << bits) - 1))))


def _numbered(base: Column, number: Column, width: int) -> Column:
    digits = number.cast("string")
    return F.concat(base, F.lit("_gen"), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0")))


def suffixed(rows: DataFrame, base: str, sequence: list[str], taken: DataFrame | None = None, width: int = 3) -> DataFrame:
    """A unique name for every row that has a base: the base alone if it is free, then ``_gen001`` and so on, leaving out names that are taken.

    Taken are the names of ``taken`` (name), and every base for the first of its own
    rows, as if these came first; ``x_gen001`` may be a base too. The k-th row that
    needs a number gets the k-th free one: a taken number b that has j taken ones up
    to it lies behind b - j free ones, so rows and taken numbers are sorted together
    by how many free numbers lie before them, and a row's number is its place among
    both. No base is numbered by one task, though it may be that of all rows.
    """
    bases = rows.where(F.col(base).isNotNull()).select(F.col(base).alias("name")).distinct()
    names = bases if taken is None else taken.where(F.col("name").isNotNull()).select("name").distinct()
    reserved = stored(names if taken is None else names.union(bases).distinct())
    parts = reserved.select("name", F.regexp_extract("name", r"(?s)^(.*)_gen(\d+)$", 1).alias("base"), F.regexp_extract("name", r"_gen(\d+)$", 1).try_cast("long").alias("number"))
    blocked = parts.where((F.col("number") > 0) & (_numbered(F.col("base"), F.col("number"), width) == F.col("name"))).select("base", "number")
    blocked = ranked_within(blocked, ["base"], ["number"]).select("base", (F.col("number") - F.col("rank")).alias("free"), F.lit(1).alias("kind"))
    if taken is None:
        spare = bases.select(F.col("name").alias("base"), F.lit(True).alias("plain"))
    else:
        spare = bases.join(names.withColumn("held", F.lit(True)), "name", "left").select(F.col("name").alias("base"), F.col("held").isNull().alias("plain"))
    placed = ranked_within(rows.where(F.col(base).isNotNull()).withColumn("base ", F.col(base)), ["base "], sequence).drop("n")
    placed = placed.join(spare.withColumnRenamed("base", "base "), "base ").withColumn("free", F.col("rank") - F.col("plain").cast("long"))
    placed = stored(placed.drop("rank", "plain").withColumnRenamed("base ", "base of name"))
    asked = placed.where(F.col("free") > 0).select(F.col("base of name").alias("base"), "free", F.lit(0).alias("kind"))
    both = ranked_within(asked.union(blocked), ["base"], ["free", "kind"]).where("kind = 0").select(F.col("base").alias("base of name"), "free", F.col("rank").alias("number"))
    numbered = placed.join(both, ["base of name", "free"], "left")
    name = F.when(F.col("free") == 0, F.col("base of name")).otherwise(_numbered(F.col("base of name"), F.col("number"), width))
    unnamed = rows.where(F.col(base).isNull()).withColumn("name", F.lit(None).cast("string"))
    return numbered.withColumn("name", name).select(*rows.columns, "name").union(unnamed)


def cyclic_targets(targets: DataFrame, group: str, preferred: Column, order: str, least: int) -> DataFrame:
    """A plan of at least ``least`` entries per group: every target once, the preferred first, then the others in turn (or the preferred, if there are no others)."""
    w = Window.partitionBy(group).orderBy(preferred.desc(), order)
    ranked = targets.withColumns({"preferred": preferred, "nth": F.row_number().over(w)})
    sizes = ranked.groupBy(group).agg(F.count("*").alias("n"), F.count_if("preferred").alias("n_preferred"))
    slots = sizes.select(group, "n", "n_preferred", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest("n", F.lit(least).cast("long")))).alias("slot"))
    others = F.col("n") - F.col("n_preferred")
    again = F.col("slot") - F.col("n") - 1
    cycled = F.when(others > 0, F.col("n_preferred") + 1 + F.try_mod(again, others)).otherwise(1 + F.try_mod(again, F.col("n")))
    slots = slots.withColumn("nth", F.when(F.col("slot") <= F.col("n"), F.col("slot")).otherwise(cycled).cast("int"))
    return slots.join(ranked, [group, "nth"]).drop("n", "n_preferred", "nth")
