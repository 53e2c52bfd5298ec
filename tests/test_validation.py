from pyspark.sql import functions as F

from caseloom.operators import bundles, validation
import entity_cases as cases

FILES = "array<struct<path:string,content:string>>"


def tables(spark):
    """The registered case tables."""
    return [spark.createDataFrame(cases.TABLES[n][1], ", ".join(f"`{c}` {k}" for c, k in (x.rsplit(" ", 1) for x in cases.TABLES[n][0].split("; ")))) for n in cases.CASE_TABLES]


def test_each_case_has_the_issues_it_was_made_for(spark):
    issues = validation.validate(*tables(spark)).collect()
    by = {}
    for r in issues:
        by.setdefault(r["task_id"], []).append(r["issue"])
    assert "good" not in by and "never_run" not in by and "report" not in by
    assert len({r["issue"] for r in issues}) == 40
    assert sorted(by["timed"]) == ["domain_metric_mismatch", "golden_equals_baseline"]
    assert sorted(by["leaks"]) == ["public_security_leak"] * 2
    assert sorted(by["opens"]) == ["evaluator_opens_undeclared_file"] * 3 + ["evaluator_skips_requirement"] * 2
    assert sorted(by["dead"]) == ["dead_check", "uncovered_requirement", "untested_requirement"]
    assert sorted(by["other_check"]) == ["uncovered_requirement"] * 2
    assert sorted(by["crashed"]) == ["vulnerable_rejection_invalid"]
    assert sorted(by["unnamed"]) == ["golden_rejected", "requirement_id_mismatch"]
    assert sorted(by["broken"]) == ["mutation_execution_error", "uncovered_requirement", "uncovered_requirement"]
    assert "skipped" not in by
    assert sorted(by["no_mutants"]) == ["untested_requirement"] * 2
    assert "no_gate" in by and "baseline_failed" in by["no_gate"]


def test_mutation_score_and_overlays(spark):
    specs, domains, requirements, mapping, files, runs, failures = tables(spark)
    _, score = validation.mutation(runs, mapping)
    got = {r["task_id"]: (r["mutation_score"], r["error_runs"]) for r in score.collect()}
    assert got["good"] == (1.0, 0) and got["other_check"] == (0.0, 0) and got["broken"] == (0.0, 3)
    states = {(r["task_id"], r["state"]) for r in validation.overlays(files, validation.submission_targets(specs, domains)).collect()}
    assert {("good", "mapped"), ("gone", "absent"), ("twice", "ambiguous"), ("unmatched", "unmapped"), ("equal", "same")} <= states


def test_routes(spark):
    issues = spark.createDataFrame([("a", "missing_interface"), ("b", "dead_check"), ("c", "strange")], "task_id string, issue string")
    gate = spark.createDataFrame([("b", "pass"), ("a", "pass")], "task_id string, status string")
    routed = validation.routed(issues, spark.createDataFrame([("b",)], "task_id string"), gate)
    assert {r["task_id"]: r["artifact"] for r in routed.collect()} == {"a": "specification", "b": "mutants", "c": "none"}


def test_bundle_faults_in_order(spark):
    allowed = F.array(F.lit("submission/a"), F.lit("submission/b"))
    cases = {
        "no_files": [], "bad_path": [("/x", "1")], "bad_content": [("submission/a", None)], "forbidden_path": [("other", "1")],
        "duplicate_path": [("submission/a", "1"), ("./submission/a", "2")], "missing_path": [("submission/a", "1")], None: [("submission/a", "1"), ("submission\\b", "2")],
    }
    df = spark.createDataFrame([(str(k), v) for k, v in cases.items()], f"want string, files {FILES}")
    for r in df.select("want", bundles.bundle_fault(F.col("files"), allowed).alias("got")).collect():
        assert r["want"] == str(r["got"])


def test_seed_faults(spark):
    seeds = [(1, "s1", "d", "c"), (2, "s1", "d", "c"), (3, "s2", "x", "c"), (4, " ", "d", "c"), (5, "s3", "d", " ")]
    df = spark.createDataFrame([(n, s, d, "t", "o", "m", "g", [c]) for n, s, d, c in seeds], "row int, seed_id string, domain_id string, title string, objective string, threat_model string, ground_truth string, constraints array<string>")
    got = {r["row"]: r["fault"] for r in bundles.seed_faults(df, spark.createDataFrame([("d",)], "domain_id string")).collect()}
    assert got == {1: None, 2: "duplicate_seed_id", 3: "unknown_domain", 4: "missing_seed_id", 5: "no_constraints"}


def test_paths_scores_and_errors(spark):
    readme = "You may only modify `inputs/core.c`. See `inputs/tb.c`, and `submission/out.json`." + " filler" * 60 + " `inputs/core.c`"
    df = spark.createDataFrame([(readme,)], "r string")
    row = df.select(bundles.readme_paths(F.col("r")).alias("p"), bundles.edit_score(F.col("r"), F.lit("inputs/core.c")).alias("s"), bundles.edit_score(F.col("r"), F.lit("inputs/none.c")).alias("n")).first()
    assert row["p"] == ["inputs/core.c", "inputs/tb.c", "submission/out.json"]
    assert row["s"] == 10 + 10 + 5 + 3 + 1 and row["n"] == 0
    error = spark.createDataFrame([("Maximum context length is 4096 tokens, but the prompt contains at least 4000 input tokens. Error code: 402",)], "e string")
    assert error.select(bundles.context_limits(F.col("e")).alias("x")).first()["x"] == (4096, 4000)
    assert error.select(bundles.account_error(F.col("e"))).first()[0] == 402


def test_overlay_replace_and_repair(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"b": "3", "c": "4"}, [("b", "x"), ("d", "y")])], f"base map<string,string>, over map<string,string>, files {FILES}")
    row = df.select(bundles.overlaid(F.col("base"), F.col("over")).alias("o"), bundles.replaced_in_place(F.col("files"), F.col("over")).alias("f")).first()
    assert row["o"] == {"a": "1", "b": "3", "c": "4"} and [tuple(x) for x in row["f"]] == [("b", "3"), ("d", "y")]
    manifest = [("evaluation/evaluate.py", "main"), ("tests/tb_top.v", "bench"), ("tests/util.py", "helpers"), ("inputs/tb_x.v", "")]
    m = spark.createDataFrame([(manifest, "Simulation stopped"), (manifest, "see tests/util.py"), (manifest, "")], "m array<struct<path:string,purpose:string>>, d string")
    got = [r[0] for r in m.select(bundles.repair_paths(F.col("m"), F.col("d"))).collect()]
    assert got == [["tests/tb_top.v", "evaluation/evaluate.py"], ["tests/util.py", "evaluation/evaluate.py"], ["evaluation/evaluate.py"]]
    k = spark.createDataFrame([("0110", "0100", [0, 1, 2, 9, -1]), ("01", "01", []), (None, "01", [0])], "a string, b string, i array<int>")
    assert [r[0] for r in k.select(bundles.position_match(F.col("a"), F.col("b"), F.col("i"))).collect()] == [0.4, 0.0, 0.0]
