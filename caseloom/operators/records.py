"""Nested records: ordered lookups, pairings, defaults and slimmed projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_allowed


def in_asked_order(wanted: DataFrame, paths: str, manifest: DataFrame, key: list[str]) -> DataFrame:
    """Manifest rows of the asked paths (an array column), with their place in the request; unknown paths are left out."""
    asked = wanted.select(*key, F.posexplode(paths).alias("place", "path"))
    return asked.join(manifest, [*key, "path"])


def zipped(a: Column, b: Column) -> Column:
    """Pairs by position, as many as the shorter array has."""
    n = F.least(F.size(a), F.size(b))
    return F.arrays_zip(F.slice(a, F.lit(1), n).alias("a"), F.slice(b, F.lit(1), n).alias("b"))


#: What counts as missing besides null: an empty text, array, map or struct, and the zero of its kind.
EMPTY = ["", "[]", "{}", "false", "0", "0.0"]


def first_value(*candidates: Column) -> Column:
    """The first candidate, of any type, that is not missing; null if all are."""
    shown = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":"?(.*?)"?\}$', 1)
    return F.coalesce(*[F.when(c.isNotNull() & ~shown(c).isin(EMPTY), c) for c in candidates])


def slim(items: Column, keep: list[str], flagged: Column, heavy: list[str], key: str, shown: int = 500) -> Column:
    """Array items with their light fields, and their heavy ones, shortened, only where the key is flagged."""
    light = lambda x: [x[f].alias(f) for f in keep]
    full = lambda x: [F.when(F.array_contains(flagged, x[key]), F.left(x[f], F.lit(shown))).alias(f) for f in heavy]
    return F.transform(items, lambda x: F.struct(*light(x), *full(x)))


def fallback_file(files: Column, reason: Column, needles: list[str]) -> Column:
    """The first JSON path below submission/, in order, if the reason speaks of any needle."""
    paths = F.filter(F.transform(files, lambda f: f["path"]), lambda p: p.startswith("submission/") & p.endswith(".json"))
    speaks = F.lit(False)
    for n in needles:
        speaks = speaks | F.contains(F.lower(reason), F.lit(n))
    return F.when(speaks, F.array_min(paths))


def localisation_score(tier: Column) -> Column:
    """Credit for how closely a finding is placed: 3 full, 2 two thirds, 1 a third."""
    return F.when(tier == 3, 1.0).when(tier == 2, 0.66).when(tier == 1, 0.33).otherwise(0.0)


def detection_metrics(findings: DataFrame, group: list[str], sure: float = 0.6) -> DataFrame:
    """Of findings (detected, is_real, confidence, tier): detection rate of real ones, share of confident false alarms, mean localisation."""
    real = F.col("is_real")
    confident_false = ~real & F.col("detected") & (F.col("confidence") >= sure)
    rate = lambda hit, base: F.coalesce(F.try_divide(F.count_if(hit), F.count_if(base)), F.lit(0.0))
    return findings.groupBy(*group).agg(
        F.bround(rate(real & F.col("detected"), real), 4).alias("detection_rate"), F.bround(rate(confident_false, ~real), 4).alias("false_alarm_rate"),
        F.bround(F.coalesce(F.avg(F.when(real & F.col("detected"), localisation_score(F.col("tier")))), F.lit(0.0)), 4).alias("localisation"),
    )


def retry_decision(call: Column) -> Column:
    """What follows an answer of each kind (truncated, filtered, empty or error; null: it stands), the first rule that holds.

    ``call`` is a struct of kind, blank (no text at all), degenerate, reasoning
    (active and not yet turned off), format (constrained and not yet dropped),
    observed, requested and cap tokens, affordable tokens, reductions so far,
    overflow, account_code, attempt and retries.
    """
    flag = lambda name: F.coalesce(call[name], F.lit(False))
    kind, used_up = call["kind"], call["attempt"] >= call["retries"]
    again = lambda name: F.when(used_up, F.lit("stop_" + name)).otherwise(F.lit("retry_" + name))
    cut = (
        F.when(flag("reasoning") & flag("blank"), "retry_without_reasoning")
        .when(flag("degenerate"), "stop_degenerate")
        .when(F.coalesce(call["observed"] < call["requested"] * F.lit(0.9), F.lit(False)), again("early_cut"))
        .when(call["requested"] >= call["cap"], "stop_at_cap")
        .otherwise("double")
    )
    empty = F.when(flag("reasoning"), "retry_without_reasoning").when(flag("format"), "retry_without_format").otherwise(again("empty"))
    affordable = F.coalesce((call["affordable"] < call["requested"]) & (call["affordable"] >= 256) & (call["reductions"] < 3), F.lit(False))
    error = F.when(affordable, "lower_to_affordable").when(flag("overflow"), "stop_overflow").when(call["account_code"].isin(401, 402, 403), "stop_account").otherwise(again("error"))
    return F.when(kind == "truncated", cut).when(kind == "filtered", again("filtered")).when(kind == "empty", empty).when(kind == "error", error)


def backoff(base: Column, attempt: Column, first: int = 0) -> Column:
    """Seconds to wait: the base doubled per attempt, counted from ``first``."""
    return base * F.pow(F.lit(2.0), attempt - F.lit(first))


def plan_budget(most: Column, base: Column, reasoning: Column, active: Column) -> Column:
    """Tokens for a plan: base and reasoning budget, doubled where reasoning is on, at most ``most``."""
    on = F.coalesce(active, F.lit(False))
    once = F.least(most, base + F.when(on, F.coalesce(reasoning, F.lit(0))).otherwise(0))
    return F.when(on, F.least(most, once * 2)).otherwise(once)


def token_limit(override: Column, agent: Column, default: Column) -> Column:
    """The first limit given: an override, the agent's own, the default, 16000."""
    return F.coalesce(override, agent, default, F.lit(16000))


def without_field(value: Column, field: str) -> Column:
    """A struct without one field, as a plan has no contents yet."""
    return value.dropFields(field)


def in_scope(manifest: Column, allowed: Column) -> Column:
    """Manifest entries whose path is allowed or blank; null where nothing is left, which is an error of the plan."""
    left = F.filter(manifest, lambda e: (F.trim(F.coalesce(e["path"], F.lit(""))) == "") | path_allowed(F.trim(e["path"]), allowed))
    return F.when(F.size(left) > 0, left)


def reconciled(declared: Column, files: Column) -> Column:
    """Declared input names, or those of the files shipped below inputs/ where there are any and the sets differ."""
    shipped = F.transform(F.filter(files, lambda f: f["path"].startswith("inputs/")), lambda f: F.element_at(F.split(f["path"], "/"), -1))
    given = F.coalesce(declared, F.array().cast("array<string>"))
    same = F.array_sort(F.array_distinct(given)) == F.array_sort(F.array_distinct(shipped))
    return F.when((F.coalesce(F.size(shipped), F.lit(0)) <= 0) | same, declared).otherwise(shipped)


def file_map(files: Column) -> Column:
    """Contents by path of an array of (path, content); of equal paths the last counts."""
    paths = F.transform(files, lambda f: F.coalesce(f["path"], F.lit("")))
    last = F.filter(F.transform(files, lambda f, i: F.struct(F.coalesce(f["path"], F.lit("")).alias("path"), F.coalesce(f["content"], F.lit("")).alias("content"), i.alias("i"))), lambda f: ~F.array_contains(F.slice(paths, f["i"] + 2, F.size(paths)), f["path"]))
    return F.map_from_entries(F.transform(last, lambda f: F.struct(f["path"], f["content"])))


def enable_counts(trace: DataFrame, cycles: int = 8) -> DataFrame:
    """Per operand of a trace (trial_id, seq, secret_operand, cycle_index, mul_en, done), from its first trial: enabled cycles of the first ``cycles``, weight, cycles that are done, and whether these are the last of them alone."""
    per_trial = trace.groupBy("trial_id").agg(
        F.min("seq").alias("first"), F.min_by("secret_operand", "seq").alias("secret_operand"), F.count_if(F.col("cycle_index").between(1, cycles) & (F.col("mul_en") == 1)).alias("enable_count"),
        F.array_sort(F.collect_set(F.when(F.col("done") == 1, F.col("cycle_index")))).alias("done_cycles"),
    )
    best = per_trial.groupBy("secret_operand").agg(F.min_by(F.struct("enable_count", "done_cycles"), "first").alias("b"))
    steady = F.coalesce((F.size("b.done_cycles") == 1) & (F.get("b.done_cycles", F.lit(0)) == cycles), F.lit(False))
    return best.select("secret_operand", "b.enable_count", F.bit_count("secret_operand").alias("weight"), "b.done_cycles", steady.alias("steady"))


def first_fault(faults: dict[str, Column]) -> Column:
    """The least path whose rule is broken (a boolean column each, null counting as broken), or null: the first error of a schema, errors being sorted by path."""
    chain = [F.when(~F.coalesce(rule, F.lit(False)), F.lit(path)) for path, rule in sorted(faults.items(), key=lambda x: x[0].split("."))]
    return F.coalesce(*chain)


def canonical_text(json_text: Column) -> Column:
    """A JSON text with the keys of all its objects in order, at every level, and no spaces: equal documents give equal texts; null for what is no JSON."""
    return F.to_json(F.try_parse_json(json_text))  # a variant keeps its fields by name


def canonical_json(value: Column) -> Column:
    """A map of strings as JSON with its keys in order, so that equal maps give equal texts."""
    entries = F.array_sort(F.map_entries(value))
    text = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    member = lambda e: F.concat(text(e["key"]), F.lit(": "), F.when(e["value"].isNull(), "null").otherwise(text(e["value"])))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, member), ", "), F.lit("}"))


def tool_payload(content: Column, calls: Column) -> Column:
    """What a model said: its content, or where that is blank the arguments of its first tool call that has any."""
    given = F.filter(F.coalesce(calls, F.array().cast("array<string>")), lambda c: F.coalesce(F.regexp_like(c, F.lit(r"\S")), F.lit(False)))
    return F.when(F.regexp_like(F.coalesce(content, F.lit("")), F.lit(r"\S")), content).otherwise(F.coalesce(F.get(given, F.lit(0)), F.lit("")))
