"""Case validation: one row per issue over normalised case tables, and the reports above them.

Tables: ``specs`` (task_id, domain_id, interface, ground_truth, input_artifacts, metrics,
public_text, mutants_skipped, repeated_failure), ``domains`` (domain_id, submission_kind,
evaluation_mode, metrics, submission_artifacts), ``requirements`` (task_id, req_id, req_type,
text), ``mapping`` (task_id, requirement_id, requirement_type), ``files`` (task_id, bundle:
artifact, tester, expert or mutant, path, content), ``runs`` (task_id, arm: golden,
vulnerable, baseline or mutant, target, status, returncode, stdout, stderr) and
``failures`` (task_id, target), the mutants that could not be made. Every branch is a filter,
a grouped count or a semi or anti join; the report is their union. A case that was never
run has no rows in ``runs`` and only the issues of its documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scores import share
from ..sources.scratch import stored
from .coverage import discrimination
from .gates import run_outcome

#: Words of which an interface that is graded by simulation needs one of each kind.
TIMING_DISCIPLINE = r"(?i)\b(moore|mealy|registered|combinational|clocked|sequential)\b"
TIMING_CYCLE = r"(?i)\b(cycle|cycles|clock edge|rising edge|falling edge|pos[- ]?edge|neg[- ]?edge|latency)\b"
#: Fixed value: a functional requirement that only restates the objective.
GENERIC_REQUIREMENT = r"(?i)satisfies the (public )?objective|meets the (stated )?objective"
EVALUATOR = "evaluation/evaluate.py"
EVALUATOR_README = "evaluation/README.md"
REQUIRED_FILES = ["README.md", "metadata.json"]
#: Endings of input files, and of those that hold code to submit.
INPUT_ENDINGS = [".cpp", ".c", ".h", ".v", ".sv", ".json", ".md", ".txt", ".tcl", ".yaml", ".py", ".vhd", ".lib"]
CODE_ENDINGS = [".cpp", ".cc", ".c", ".h", ".hpp", ".v", ".sv", ".vhd", ".py", ".tcl"]
#: How a script names a file it opens among its inputs.
OPENED_FILE = [
    r"""open\s*\(\s*['"f]?(?:f?['"'])?inputs/([\w.\-]+)""",
    r"""os\.path\.join\s*\(\s*['"]inputs['"]\s*,\s*['"]([\w.\-]+)['"]""",
    r"""Path\s*\(\s*['"]inputs['"]\s*\)\s*/\s*['"]([\w.\-]+)['"]""",
    r"""['"]inputs/([\w.\-]+)['"]""",
]
SKIPPED = r"\[TEST\]\s*SKIP\s*:\s*([\w-]+)"

#: Domain, kind of submission, mode of evaluation, metrics, files to submit.
DOMAINS = [
    ("hls_security_codegen", "hardened_artifact", "compile_and_run", ["cwe_violation_rate", "information_flow_correctness", "synthesis_pass_rate"], []),
    ("rtl_trojan_detection", "analysis_report", "report_grading", ["detection_rate", "false_positive_rate", "trigger_payload_localization"], ["trojan_report.json"]),
    ("gate_trojan_detection", "analysis_report", "report_grading", ["detection_rate", "false_positive_rate", "inference_latency"], ["trojan_report.json"]),
    ("hardware_reverse_engineering", "analysis_report", "simulate", ["word_recovery_rate", "structural_match_accuracy", "functional_equivalence"], ["recovered_rtl.v"]),
    ("side_channel_fault_analysis", "analysis_report", "report_grading", ["leakage_detection_accuracy", "fault_coverage", "hardening_precision"], ["vulnerability_report.json"]),
    ("logic_deobfuscation_sat", "analysis_report", "report_grading", ["key_recovery_rate", "key_gate_localization_accuracy", "sat_iteration_reduction"], ["recovered_key.json"]),
]


def domain_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DOMAINS, "domain_id string, submission_kind string, evaluation_mode string, metrics array<string>, submission_artifacts array<string>")


def opened_files(script: Column) -> Column:
    """Names of input files that a script opens; mentions in comments and docstrings do not count."""
    code = F.regexp_replace(F.regexp_replace(F.regexp_replace(script, r"(?s)'''.*?'''", ""), r'(?s)""".*?"""', ""), r"(?m)#.*$", "")
    found = F.concat(*[F.regexp_extract_all(code, F.lit(p), F.lit(1)) for p in OPENED_FILE])
    return F.filter(F.array_distinct(found), lambda x: x.contains("."))


def _issues(rows: DataFrame, issue: str, detail: Column | None = None) -> DataFrame:
    return rows.select("task_id", F.lit(issue).alias("issue"), (F.lit("") if detail is None else F.coalesce(detail, F.lit(""))).alias("detail"))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _none(c: str) -> Column:
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def _ends_with(c: Column, endings: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.endswith(e) for e in endings])


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def spec_issues(specs: DataFrame, domains: DataFrame, files: DataFrame) -> list[DataFrame]:
    """Issues that a specification shows by itself or against its domain."""
    known = specs.join(domains.withColumnRenamed("metrics", "domain_metrics"), "domain_id")
    simulated, hardened = known.where(F.col("evaluation_mode") == "simulate"), known.where(F.col("submission_kind") == "hardened_artifact")
    timed = F.regexp_like("interface", F.lit(TIMING_DISCIPLINE)) & F.regexp_like("interface", F.lit(TIMING_CYCLE))
    artifacts = specs.select("task_id", F.explode("input_artifacts").alias("name"))
    unsolved = specs.where(F.coalesce("ground_truth", F.lit("")) == "").join(files.where(F.col("bundle") == "expert"), "task_id", "left_anti")
    return [
        _issues(specs.join(domains, "domain_id", "left_anti"), "unknown_domain", F.col("domain_id")),
        _issues(specs.where(F.coalesce("task_id", F.lit("")) == ""), "missing_task_id"),
        _issues(specs.where(_none("input_artifacts")), "missing_input_artifacts"),
        _issues(artifacts.where(~_ends_with(F.col("name"), INPUT_ENDINGS) | F.contains("name", F.lit(" "))), "input_artifact_not_filename", F.col("name")),
        _issues(unsolved, "missing_ground_truth"),
        _issues(hardened.where(_blank("interface")), "missing_interface"),
        _issues(simulated.where(_blank("interface") | ~timed), "missing_timing_discipline"),
        _issues(specs.where(_none("metrics")), "missing_metrics"),
        _issues(known.where(~_none("metrics") & ~F.arrays_overlap("metrics", "domain_metrics")), "domain_metric_mismatch"),
    ]


def leak_issues(specs: DataFrame, domains: DataFrame, files: DataFrame) -> list[DataFrame]:
    """What a participant of a hardening task could read of its hidden intent: names of inputs, the public specification, names of files or else what they hold."""
    hardened = specs.join(domains.where(F.col("submission_kind") == "hardened_artifact").select("domain_id"), "domain_id", "left_semi")
    names = hardened.select("task_id", F.explode("input_artifacts").alias("name"))
    reveals = lambda c: F.regexp_like(c, F.lit(text.REVEALING_NAME))
    shown = files.where(F.col("bundle") == "artifact").join(hardened, "task_id", "left_semi").withColumns({"named": reveals(_name(F.col("path"))), "leaks": text.leaked_tokens(F.col("content"))})
    return [
        _issues(names.where(reveals(F.col("name"))), "public_security_leak", F.col("name")),
        _issues(hardened.where(F.size(text.leaked_tokens(F.col("public_text"))) > 0), "public_security_leak", F.array_join(text.leaked_tokens(F.col("public_text")), " ")),
        _issues(shown.where(F.col("named") | (F.size("leaks") > 0)), "public_security_leak", F.when(F.col("named"), F.col("path")).otherwise(F.concat_ws(" ", "path", F.array_join("leaks", " ")))),
    ]


def file_issues(specs: DataFrame, files: DataFrame) -> list[DataFrame]:
    """Missing and unsafe files, and what the evaluator opens or skips."""
    wanted = specs.select("task_id", F.explode(F.array(*[F.lit(p) for p in REQUIRED_FILES])).alias("path"))
    missing = wanted.join(files.where(F.col("bundle") == "artifact").select("task_id", "path"), ["task_id", "path"], "left_anti")
    tests = files.where(F.col("bundle") == "tester")
    evaluators = tests.where(F.col("path") == EVALUATOR)
    opened = evaluators.select("task_id", F.explode(opened_files(F.col("content"))).alias("name"))
    declared = specs.select("task_id", F.explode("input_artifacts").alias("name"))
    skipped = evaluators.select("task_id", F.explode(F.regexp_extract_all("content", F.lit(SKIPPED), F.lit(1))).alias("id"))
    unsafe = files.where(F.col("bundle") != "mutant").select("task_id", "bundle", "path").distinct().unionByName(files.where(F.col("bundle") == "mutant").select("task_id", "bundle", "path"))
    return [
        _issues(missing, "missing_case_file", F.col("path")),
        _issues(specs.join(evaluators, "task_id", "left_anti"), "missing_evaluator"),
        _issues(specs.join(tests.where(F.col("path") == EVALUATOR_README), "task_id", "left_anti"), "missing_evaluator_readme"),
        _issues(unsafe.where(~text.safe_path(F.col("path"))), "unsafe_output_path", F.col("path")),
        _issues(opened.join(declared, ["task_id", "name"], "left_anti"), "evaluator_opens_undeclared_file", F.col("name")),
        _issues(skipped, "evaluator_skips_requirement", F.col("id")),
    ]


def requirement_issues(specs: DataFrame, requirements: DataFrame, mapping: DataFrame) -> list[DataFrame]:
    """Requirements against their mapping: absent, repeated, unknown, of another type. Of an id declared as both types the security requirement counts."""
    functional = requirements.where(F.col("req_type") == "functional")
    per_task = functional.groupBy("task_id").agg(F.count("*").alias("n"), F.count_if(F.regexp_like("text", F.lit(GENERIC_REQUIREMENT))).alias("generic"))
    named = requirements.where(~_blank("req_id")).select("task_id", F.trim("req_id").alias("id"), "req_type")
    mapped = mapping.where(~_blank("requirement_id")).select("task_id", F.trim("requirement_id").alias("id"), F.trim(F.coalesce("requirement_type", F.lit(""))).alias("mapped_type"))
    declared = named.groupBy("task_id", "id").agg(F.max("req_type").alias("declared_type"))
    repeated = lambda df: df.groupBy("task_id", "id").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    both = mapped.join(declared, ["task_id", "id"], "left")
    return [
        _issues(specs.join(functional, "task_id", "left_anti"), "missing_functional_requirements"),
        _issues(per_task.where((F.col("n") == 1) & (F.col("generic") == 1)), "generic_functional_requirement"),
        _issues(repeated(named), "duplicate_requirement_id", F.col("id")),
        _issues(requirements.where(_blank("req_id")), "missing_requirement_id", F.col("req_type")),
        _issues(specs.join(mapping, "task_id", "left_anti"), "missing_requirement_map"),
        _issues(repeated(mapped), "duplicate_requirement_mapping", F.col("id")),
        _issues(both.where(F.col("declared_type").isNull()), "unknown_requirement_mapping", F.col("id")),
        _issues(both.where((F.col("mapped_type") != "") & (F.col("mapped_type") != F.col("declared_type"))), "requirement_type_mismatch", F.col("id")),
        _issues(declared.join(mapped, ["task_id", "id"], "left_anti"), "missing_requirement_harness", F.col("id")),
    ]


def submission_targets(specs: DataFrame, domains: DataFrame) -> DataFrame:
    """(task_id, target): the code inputs of a hardening task, else the domain's files below submission/."""
    known = specs.join(domains.drop("metrics"), "domain_id")
    code = F.transform(F.filter(F.coalesce("input_artifacts", F.array().cast("array<string>")), lambda f: _ends_with(f, CODE_ENDINGS)), lambda f: F.concat(F.lit("inputs/"), f))
    reports = F.transform("submission_artifacts", lambda f: F.concat(F.lit("submission/"), f))
    return known.select("task_id", F.explode(F.when(F.col("submission_kind") == "hardened_artifact", code).otherwise(reports)).alias("target")).distinct()


def overlays(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Where each golden file goes: submission targets matched by their exact file name with the expert's files below a ``golden`` folder.

    state is ``absent`` (no such target in the case), ``ambiguous`` (several golden files), ``unmapped`` (none), ``same`` (equal to the baseline) or ``mapped``.
    """
    expert = files.where((F.col("bundle") == "expert") & F.array_contains(F.split("path", "/"), "golden"))
    golden = expert.groupBy("task_id", _name(F.col("path")).alias("name")).agg(F.count("*").alias("n"), F.min("content").alias("golden"))
    present = files.where(F.col("bundle") != "mutant").groupBy("task_id", F.col("path").alias("target")).agg(F.max_by(F.coalesce("content", F.lit("")), F.col("bundle") == "artifact").alias("baseline"))
    joined = targets.withColumn("name", _name(F.col("target"))).join(golden, ["task_id", "name"], "left").join(present, ["task_id", "target"], "left")
    state = (
        F.when(F.col("baseline").isNull(), "absent")
        .when(F.col("n") > 1, "ambiguous")
        .when(F.col("n").isNull(), "unmapped")
        .when(F.col("golden").eqNullSafe(F.col("baseline")), "same")
        .otherwise("mapped")
    )
    return joined.select("task_id", "target", state.alias("state"))


def overlay_issues(specs: DataFrame, domains: DataFrame, plan: DataFrame, ran: DataFrame) -> list[DataFrame]:
    """Issues of the overlay plan (see ``overlays``) of cases that were run (task_id); a case of an unknown domain has no plan."""
    known = specs.join(domains, "domain_id", "left_semi").join(ran, "task_id", "left_semi")
    plan = plan.join(ran, "task_id", "left_semi")
    fits = F.count_if(F.col("state").isin("same", "mapped"))
    per_task = known.select("task_id").join(plan.groupBy("task_id").agg(fits.alias("fits"), F.count_if(F.col("state") == "mapped").alias("changed")), "task_id", "left").na.fill(0, ["fits", "changed"])
    return [
        _issues(specs.join(domains, "domain_id", "left_anti").join(ran, "task_id", "left_semi"), "unknown_domain", F.lit("submission targets")),
        _issues(plan.where(F.col("state") == "absent"), "submission_target_missing", F.col("target")),
        _issues(plan.where(F.col("state") == "ambiguous"), "golden_overlay_ambiguous", F.col("target")),
        _issues(per_task.where(F.col("fits") == 0), "golden_overlay_missing"),
        _issues(per_task.where((F.col("fits") > 0) & (F.col("changed") == 0)), "golden_equals_baseline"),
    ]


def _ids(rows: DataFrame, column: str, name: str) -> DataFrame:
    return rows.where(~_blank(column)).groupBy("task_id").agg(F.collect_set(F.trim(column)).alias(name))


def differential(runs: DataFrame, requirements: DataFrame) -> DataFrame:
    """Per task with a golden and a vulnerable run: whether each is as it should be, status, failure class and signature.

    The golden run passes, without a failed check, a broken set-up or a crash, and
    names every declared requirement; the vulnerable run fails in a declared
    requirement, without a broken set-up or a crash.
    """
    out, err = F.coalesce("stdout", F.lit("")), F.coalesce("stderr", F.lit(""))
    arms = runs.where(F.col("arm").isin("golden", "vulnerable")).select(
        "task_id", "arm", "status", "returncode", "stdout", "stderr", text.markers(out, text.FAIL_MARKER).alias("failed"), text.markers(out, text.PASS_OR_FAIL_MARKER).alias("seen"),
        F.contains(out, F.lit(text.SETUP_FAILURE)).alias("setup"), F.contains(err, F.lit(text.CRASH)).alias("crash"),
    )
    one = F.struct(*[c for c in arms.columns if c not in ("task_id", "arm")])
    arm = lambda name: arms.where(F.col("arm") == name).groupBy("task_id").agg(F.first(one).alias(name[0]))
    wide = arm("golden").join(arm("vulnerable"), "task_id").join(_ids(requirements, "req_id", "ids"), "task_id", "left")
    wide = wide.withColumn("ids", F.coalesce("ids", F.array().cast("array<string>")))
    golden = (F.col("g.status") == "pass") & (F.size("g.failed") == 0) & ~F.col("g.setup") & ~F.col("g.crash") & (F.size(F.array_except("ids", "g.seen")) == 0)
    vulnerable = (F.col("v.status") == "fail") & (F.size("v.failed") > 0) & ((F.size("ids") == 0) | F.arrays_overlap("v.failed", "ids")) & ~F.col("v.setup") & ~F.col("v.crash")
    judged = wide.withColumns({"golden_ok": F.coalesce(golden, F.lit(False)), "vulnerable_ok": F.coalesce(vulnerable, F.lit(False))})
    broken = F.col("g.status").isin("error", "timeout") | F.col("v.status").isin("error", "timeout")
    kind = (
        F.when(F.col("golden_ok") & F.col("vulnerable_ok"), F.lit(None).cast("string"))
        .when(broken, "runner_error")
        .when(F.col("g.setup") | F.col("v.setup"), "setup_error")
        .when(F.col("g.crash") | F.col("v.crash"), "evaluator_error")
        .when(~F.col("golden_ok") & ~F.col("vulnerable_ok"), "multiple")
        .when(~F.col("golden_ok"), "golden_rejected")
        .otherwise("vulnerable_accepted")
    )
    signature = text.failure_signature(F.col("failure_class"), F.col("g"), F.col("v"))
    judged = judged.withColumn("failure_class", kind)
    return judged.select(
        "task_id", "golden_ok", "vulnerable_ok", F.when(F.col("failure_class").isNull(), "pass").otherwise("fail").alias("status"), "failure_class", signature.alias("failure_signature"),
        F.col("v.status").alias("vulnerable_status"), F.col("g.seen").alias("golden_seen"),
    )


def mutation(runs: DataFrame, mapping: DataFrame, measured: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Mutant runs: per mapped requirement where it falls short, and per task the score (kills by the targeted check per run that did not break) and its broken runs.

    ``measured`` (task_id), if given, holds the tasks whose mutants mean anything;
    of the others only those without any mutant are judged, all of them untested.
    """
    ids = mapping.where(~_blank("requirement_id")).select("task_id", F.trim("requirement_id").alias("target")).distinct()
    mutants = runs.where(F.col("arm") == "mutant")
    if measured is not None:
        ids = ids.join(measured, "task_id", "left_semi").union(ids.join(measured, "task_id", "left_anti").join(mutants, "task_id", "left_anti"))
    failed = text.markers(F.coalesce("stdout", F.lit("")), text.FAIL_MARKER)
    outcome = run_outcome(F.col("status"), F.col("stdout"), F.col("stderr"))
    judged = mutants.select("task_id", "target", failed.alias("failed"), (outcome == "error").alias("broke"))
    per_check = discrimination(ids, judged, ["task_id"], "target")
    hit = ~F.col("broke") & F.array_contains("failed", F.col("target"))
    scored = judged.join(ids, ["task_id", "target"], "left_semi").groupBy("task_id").agg(F.count_if(~F.col("broke")).alias("valid"), F.count_if(hit).alias("kills"), F.count_if("broke").alias("error_runs"))
    return per_check, scored.withColumn("mutation_score", F.bround(share(F.col("kills"), F.col("valid")), 3))


def run_issues(specs: DataFrame, requirements: DataFrame, mapping: DataFrame, files: DataFrame, runs: DataFrame, failures: DataFrame, plan: DataFrame) -> list[DataFrame]:
    """Issues of the differential and the mutant runs."""
    gate = stored(differential(runs, requirements))
    mapped = _ids(mapping, "requirement_id", "mapped")
    unnamed = gate.join(mapped, "task_id").withColumn("unnamed", F.array_sort(F.array_except("mapped", "golden_seen")))
    status = lambda arm, name: runs.where(F.col("arm") == arm).groupBy("task_id").agg(F.first("status").alias(name))
    fits = plan.where(F.col("state").isin("same", "mapped")).select("task_id").distinct().withColumn("fits", F.lit(True))
    started = specs.select("task_id", "mutants_skipped").join(status("golden", "golden"), "task_id", "left").join(status("baseline", "baseline"), "task_id", "left").join(fits, "task_id", "left")
    started = stored(started.withColumn("first", F.when(F.col("fits") & F.col("golden").isNotNull(), F.col("golden")).otherwise(F.col("baseline"))))
    evaluators = files.where((F.col("bundle") == "tester") & (F.col("path") == EVALUATOR))
    measured = started.where(F.col("first") == "pass").join(evaluators, "task_id", "left_semi").select("task_id")
    per_check, scored = map(stored, mutation(runs, mapping, measured))
    ran = runs.select("task_id").distinct()
    live = specs.where(~F.coalesce("mutants_skipped", F.lit(False))).join(ran, "task_id", "left_semi")
    states = per_check.join(live, "task_id", "left_semi")
    failing = started.where(F.col("first") != "pass").join(gate, "task_id", "left_anti").join(runs.where(F.col("arm") == "mutant"), "task_id", "left_semi")
    return [
        _issues(gate.where(~F.col("golden_ok")), "golden_rejected"),
        _issues(unnamed.where(F.size("unnamed") > 0), "requirement_id_mismatch", F.array_join("unnamed", " ")),
        _issues(gate.where(~F.col("vulnerable_ok") & (F.col("vulnerable_status") == "pass")), "vulnerable_accepted"),
        _issues(gate.where(~F.col("vulnerable_ok") & ~F.col("vulnerable_status").eqNullSafe(F.lit("pass"))), "vulnerable_rejection_invalid"),
        _issues(failing, "baseline_failed"),
        _issues(states.where("dead"), "dead_check", F.col("target")),
        _issues(states.where("uncovered"), "uncovered_requirement", F.col("target")),
        _issues(states.where("untested"), "untested_requirement", F.col("target")),
        _issues(scored.where(F.col("error_runs") > 0).join(live, "task_id", "left_semi"), "mutation_execution_error", F.col("error_runs").cast("string")),
        _issues(failures.join(ran, "task_id", "left_semi").groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_set("target")), " ").alias("targets")), "mutation_generation_failure", F.col("targets")),
        _issues(specs.where(F.coalesce("repeated_failure", F.lit(False))), "repeated_preflight_failure"),
    ]


def validate(specs: DataFrame, domains: DataFrame, requirements: DataFrame, mapping: DataFrame, files: DataFrame, runs: DataFrame, failures: DataFrame) -> DataFrame:
    """All issues of all cases: task_id, issue, detail. What several branches need is written once."""
    parts = [*spec_issues(specs, domains, files), *leak_issues(specs, domains, files), *file_issues(specs, files), *requirement_issues(specs, requirements, mapping)]
    plan = stored(overlays(files, submission_targets(specs, domains)))
    parts += overlay_issues(specs, domains, plan, runs.select("task_id").distinct())
    parts += run_issues(specs, requirements, mapping, files, runs, failures, plan)
    return reduce(DataFrame.unionByName, parts)


def report(specs: DataFrame, issues: DataFrame) -> DataFrame:
    """task_id, n_issues and status: pass exactly where a case has no issue."""
    counted = issues.groupBy("task_id").agg(F.count("*").alias("n_issues"))
    joined = specs.select("task_id").join(counted, "task_id", "left").na.fill(0, ["n_issues"])
    return joined.withColumn("status", F.when(F.col("n_issues") == 0, "pass").otherwise("fail"))


#: Which artifact an issue sends back for revision.
ROUTES = {
    "missing_interface": "specification", "missing_timing_discipline": "specification", "missing_functional_requirements": "specification", "generic_functional_requirement": "specification",
    "missing_input_artifacts": "case_artifacts", "missing_ground_truth": "case_artifacts", "public_security_leak": "case_artifacts",
    "evaluator_opens_undeclared_file": "evaluation_framework", "input_artifact_not_filename": "evaluation_framework", "evaluator_skips_requirement": "evaluation_framework",
    "missing_requirement_harness": "evaluation_framework", "golden_rejected": "evaluation_framework", "vulnerable_accepted": "evaluation_framework",
    "requirement_id_mismatch": "evaluation_framework", "baseline_failed": "evaluation_framework", "dead_check": "evaluation_framework", "uncovered_requirement": "evaluation_framework",
}


def routed(issues: DataFrame, generation_failures: DataFrame, gate: DataFrame) -> DataFrame:
    """Issues with the artifact to revise; where only mutants are missing and the differential passes, it is ``mutants``."""
    route = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    only_mutants = gate.where(F.col("status") == "pass").join(generation_failures.select("task_id"), "task_id", "left_semi").select("task_id", F.lit(True).alias("only_mutants"))
    joined = issues.join(only_mutants, "task_id", "left")
    return joined.withColumn("artifact", F.when(F.col("only_mutants"), "mutants").otherwise(F.coalesce(F.try_element_at(route, F.col("issue")), F.lit("none")))).drop("only_mutants")
