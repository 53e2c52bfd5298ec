"""Bundles of files and rows of seeds: contracts as ordered reasons, overlays, replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import text


def bundle_fault(files: Column, allowed: Column) -> Column:
    """The first fault of an answer's files (array of path, content) against the paths allowed, or null: no_files, bad_path, bad_content, forbidden_path, duplicate_path, missing_path."""
    paths = F.transform(files, lambda f: text.normal_path(f["path"]))
    return (
        F.when(F.coalesce(F.size(files), F.lit(0)) <= 0, "no_files")
        .when(F.exists(paths, lambda p: p.isNull()), "bad_path")
        .when(F.exists(files, lambda f: f["content"].isNull()), "bad_content")
        .when(F.size(F.array_except(paths, allowed)) > 0, "forbidden_path")
        .when(F.size(F.array_distinct(paths)) < F.size(paths), "duplicate_path")
        .when(F.size(F.array_except(allowed, paths)) > 0, "missing_path")
    )


def mutant_fault(mutants: Column, target: Column, allowed: Column) -> Column:
    """The first fault of a generator's answer: not_one, wrong_target, no_files, unsafe_path, outside_scope, or null."""
    one = F.get(mutants, F.lit(0))
    files = one["files"]
    return (
        F.when(F.coalesce(F.size(mutants), F.lit(0)) != 1, "not_one")
        .when(F.trim(F.coalesce(one["target_requirement_id"], F.lit(""))) != target, "wrong_target")
        .when(F.coalesce(F.size(files), F.lit(0)) <= 0, "no_files")
        .when(F.exists(files, lambda f: ~text.safe_path(F.trim(f["path"]))), "unsafe_path")
        .when(F.exists(files, lambda f: ~F.array_contains(allowed, F.trim(f["path"]))), "outside_scope")
    )


def seed_faults(seeds: DataFrame, domains: DataFrame) -> DataFrame:
    """Seeds with their first fault: missing_<field>, duplicate_seed_id (later ones), unknown_domain, no_constraints, or null. ``row`` gives the order."""
    fields = ["seed_id", "domain_id", "title", "objective", "threat_model", "ground_truth"]
    blank = F.coalesce(*[F.when(F.trim(F.coalesce(F.col(f), F.lit(""))) == "", f"missing_{f}") for f in fields])
    nth = F.row_number().over(Window.partitionBy(F.trim("seed_id")).orderBy("row"))
    known = domains.select("domain_id", F.lit(True).alias("known"))
    joined = seeds.withColumn("nth", nth).join(known, "domain_id", "left")
    empty = (F.coalesce(F.size("constraints"), F.lit(0)) <= 0) | F.exists("constraints", lambda c: F.trim(F.coalesce(c, F.lit(""))) == "")
    fault = F.coalesce(blank, F.when(F.col("nth") > 1, "duplicate_seed_id"), F.when(F.col("known").isNull(), "unknown_domain"), F.when(empty, "no_constraints"))
    return joined.withColumn("fault", fault).drop("nth", "known")


def overlaid(base: Column, over: Column) -> Column:
    """Files by path (maps), the right side replacing the left."""
    return F.map_concat(F.map_filter(base, lambda k, _: ~F.map_contains_key(over, k)), over)


def replaced_in_place(files: Column, repaired: Column) -> Column:
    """An array of (path, content) with repaired contents (map by path), in the same order."""
    return F.transform(files, lambda f: F.struct(f["path"].alias("path"), F.coalesce(F.try_element_at(repaired, f["path"]), f["content"]).alias("content")))


def repair_paths(manifest: Column, diagnostic: Column, evaluator: str = "evaluation/evaluate.py") -> Column:
    """Files of a manifest (array of path, purpose) to repair: those the diagnostic names, harness files if it speaks of a failed simulation, the evaluator last."""
    support = lambda p: p.startswith("evaluation/") | p.startswith("tests/")
    simulated = F.regexp_like(F.lower(diagnostic), F.lit("compile failed|compilation failed|simulation|no marker|missing marker|mismatch at time"))
    harness = lambda f: F.regexp_like(F.lower(F.concat_ws(" ", f["path"], f["purpose"])), F.lit("testbench|harness|simulation|tb_|_tb"))
    chosen = F.filter(manifest, lambda f: support(f["path"]) & (f["path"] != evaluator) & (F.contains(diagnostic, f["path"]) | (simulated & harness(f))))
    paths = F.array_sort(F.array_distinct(F.transform(chosen, lambda f: f["path"])))
    return F.when(F.exists(manifest, lambda f: f["path"] == evaluator), F.concat(paths, F.array(F.lit(evaluator)))).otherwise(paths)


def position_match(given: Column, truth: Column, positions: Column) -> Column:
    """Share of positions (0-based) at which two strings agree; positions outside either count as mismatches, none give 0."""
    hits = F.filter(positions, lambda i: (i >= 0) & (i < F.length(given)) & (i < F.length(truth)) & (F.substr(given, i + 1, F.lit(1)) == F.substr(truth, i + 1, F.lit(1))))
    return F.when(given.isNull() | truth.isNull() | (F.coalesce(F.size(positions), F.lit(0)) <= 0), 0.0).otherwise(F.try_divide(F.size(hits), F.size(positions)))


def readme_paths(readme: Column) -> Column:
    """Workspace paths in back-ticks, trailing marks stripped, in order of appearance."""
    raw = F.regexp_extract_all(readme, F.lit(r"`((?:inputs|submission)/[^`\s]+)`"), F.lit(1))
    clean = F.transform(raw, lambda p: text.normal_path(F.regexp_replace(p, r"[.,;:)]+$", "")))
    return F.array_distinct(F.array_compact(clean))


#: Weights of words near a path that say it is to be changed.
EDIT_WORDS = [("only modify", 10), ("may only modify", 10), ("should edit", 8), ("file you should edit", 8), ("you should edit", 7), ("modify", 5), ("edit", 5), ("submission", 3), ("replace", 3), ("harden", 2)]


def edit_score(readme: Column, path: Column, around: int = 120) -> Column:
    """Sum, over the places a path is named, of the weights of edit words within ``around`` characters, and 1 if its file name occurs."""
    low, key = F.lower(readme), F.lower(path)
    pieces = F.split(low, F.concat(F.lit("\\Q"), key, F.lit("\\E")), -1)
    # around the i-th mention stand the end of what is before it and the start of what is behind it: as many pieces, with the path between them, as could fill that length
    mention = F.sequence(F.lit(1), F.size(pieces) - 1)
    enough = F.lit(around) / F.greatest(F.char_length(key), F.lit(1)) + 2
    held = enough.cast("int")
    before = lambda i: F.concat_ws("", F.transform(F.slice(pieces, F.greatest(i - held + 1, F.lit(1)), F.least(i, held)), lambda p, k: F.when(k > 0, F.concat(key, p)).otherwise(p)))
    behind = lambda i: F.concat_ws("", F.transform(F.slice(pieces, i + 1, held), lambda p, k: F.when(k > 0, F.concat(key, p)).otherwise(p)))
    near = lambda i: F.concat(F.right(before(i), F.lit(around)), key, F.left(behind(i), F.lit(around)))
    weight = lambda c: sum((F.when(c.contains(w), n).otherwise(0) for w, n in EDIT_WORDS), F.lit(0))
    total = F.aggregate(F.transform(F.when(F.size(pieces) > 1, mention).otherwise(F.array().cast("array<int>")), near), F.lit(0), lambda s, c: s + weight(c))
    return total + F.when(F.contains(low, F.element_at(F.split(key, "/"), -1)), 1).otherwise(0)


#: Domains by what the name of a case, or else its readme, holds; the first that fits counts.
NAME_HINTS = [
    ("hls", "hls_security_codegen"), ("rtl_trojan", "rtl_trojan_detection"), ("gate_trojan", "gate_trojan_detection"), ("reverse", "hardware_reverse_engineering"), ("side_channel", "side_channel_fault_analysis"),
    ("fault", "side_channel_fault_analysis"), ("deobfus", "logic_deobfuscation_sat"), ("logic_lock", "logic_deobfuscation_sat"), ("sat", "logic_deobfuscation_sat"),
]
README_HINTS = [
    ("trojan_report.json", "rtl_trojan_detection"), ("vulnerability_report.json", "side_channel_fault_analysis"), ("recovered_key.json", "logic_deobfuscation_sat"), ("recovered_rtl.v", "hardware_reverse_engineering"), ("hls", "hls_security_codegen"),
]


def inferred_domain(documents: list[Column], name: Column, readme: Column, known: list[str]) -> Column:
    """The domain of a case: the first known one that its JSON documents name, in their order and that of their keys, else by its name, else by its readme, or null."""
    keys = ["domain_id", "domain", "task_domain"]
    paths = [f"$.{k}" for k in keys] + [f"$.{parent}.{k}" for parent in ("public_spec", "task_spec", "spec", "metadata") for k in keys]
    named = [F.when((value := F.get_json_object(d, p)).isin(known), value) for d in documents for p in paths]
    none = F.lit(None).cast("string")
    by = lambda c, hints: F.nullif(text.first_rule(F.coalesce(c, F.lit("")), hints, ""), F.lit(""))
    return F.coalesce(*named, by(name, NAME_HINTS), by(readme, README_HINTS), none)


#: Endings of files that hold code.
CODE_EXTENSIONS = ["c", "cc", "cpp", "cxx", "h", "hh", "hpp", "v", "sv", "vhd", "vhdl", "py", "tcl"]


def allowed_paths(cases: DataFrame) -> DataFrame:
    """``cases`` (readme, contract: files to submit, or null for a hardening task, files: paths of the case) with ``allowed``, what a participant may write.

    The contract's files below submission/; else the code below inputs/ that the
    readme names and, by the words around, asks to be changed (a score of at least
    5 and within 4 of the best); else all code below inputs/.
    """
    code = lambda p: F.lower(F.regexp_extract(p, r"[^/.][^/]*\.([^./]*)$", 1)).isin(CODE_EXTENSIONS)
    named = F.filter(readme_paths(F.coalesce("readme", F.lit(""))), lambda p: p.startswith("inputs/") & code(p))
    scored = F.transform(named, lambda p: F.struct(edit_score(F.coalesce("readme", F.lit("")), p).alias("score"), p.alias("path")))
    best = F.array_max(F.transform(scored, lambda x: x["score"]))
    chosen = F.array_sort(F.array_distinct(F.transform(F.filter(scored, lambda x: x["score"] >= F.greatest(F.lit(5), best - 4)), lambda x: x["path"])))
    rest = F.array_sort(F.filter("files", lambda p: p.startswith("inputs/") & code(p)))
    contract = F.transform("contract", lambda f: F.concat(F.lit("submission/"), f))
    return cases.withColumn("allowed", F.when(F.col("contract").isNotNull(), contract).when(F.size(chosen) > 0, chosen).otherwise(rest))


def context_limits(error: Column) -> Column:
    """(context, used) tokens that a context-length error names, nulls otherwise."""
    pattern = r"(?is)maximum context length is (\d+) tokens.*?prompt contains at least (\d+) input tokens"
    number = lambda i: F.nullif(F.regexp_extract(error, pattern, i), F.lit("")).try_cast("long")
    return F.struct(number(1).alias("context"), number(2).alias("used"))


def account_error(error: Column) -> Column:
    """The terminal account code (401, 402, 403) that an error names, or null."""
    code = F.nullif(F.regexp_extract(error, r"Error code:\s*(\d+)", 1), F.lit("")).try_cast("int")
    return F.when(code.isin(401, 402, 403), code)
