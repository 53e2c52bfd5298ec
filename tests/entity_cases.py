"""Operators over small entity tables: case validation, repair rounds, records of runs.

The tables stand here as rows and are given to Spark and to SQL alike. Each SQL
text says what a table's rows mean by itself, with other means than the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.functions import jsonx, text
from caseloom.operators import bundles, coverage, gates, graph, ranking, records, validation
from caseloom.sources import records as sources

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

Row = tuple

#: Entity tables: columns as Spark SQL types, and rows.
TABLES: dict[str, tuple[str, list[Row]]] = {}


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, list):
        return "[" + ", ".join(map(_literal, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"'{k}': {_literal(v)}" for k, v in value.items()) + "}"
    return repr(value)


_DUCK = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def _duck_type(kind: str) -> str:
    if kind.startswith("array<"):
        return _duck_type(kind[6:-1]) + "[]"
    if kind.startswith("struct<"):
        return "STRUCT(" + ", ".join(f'"{n}" {_duck_type(k)}' for n, k in (x.split(":") for x in kind[7:-1].split(","))) + ")"
    return _DUCK[kind]


def _columns(schema: str) -> list[tuple[str, str]]:
    return [tuple(c.rsplit(" ", 1)) for c in schema.split("; ")]


def _table_sql(name: str) -> str:
    """The table as a common table expression of DuckDB."""
    schema, rows = TABLES[name]
    columns = _columns(schema)
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    casts = ", ".join(f'"{n}"::{_duck_type(k)} AS "{n}"' for n, k in columns)
    return f"{name} AS (SELECT {casts} FROM (VALUES {values}) v({', '.join(n for n, _ in columns)}))"


def _query(names: list[str], sql: str):
    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            def table(name: str) -> DataFrame:
                schema, rows = TABLES[name]
                return spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in _columns(schema)))

            return f(table)

        QUERIES[f.__name__] = run
        given = ", ".join(map(_table_sql, names))
        ORACLE_SQL[f.__name__] = f"WITH {'RECURSIVE ' if sql.startswith('RECURSIVE ') else ''}{given}{', ' if not sql.startswith('SELECT') else ' '}{sql.removeprefix('RECURSIVE ')}"
        return f

    return add


# case validation: one case without an issue, and for each rule cases that break it

HLS, RTL, SIM = "hls_security_codegen", "rtl_trojan_detection", "hardware_reverse_engineering"
_TIMED = "module top: registered output, latency of two cycles"
_OK, _CAUGHT = "[TEST] PASS: FR1\n[TEST] PASS: SR1", "[TEST] PASS: FR1\n[TEST] FAIL: SR1"
_CRASH = "Traceback (most recent call last)\nKeyError"
_SPEC = {"domain_id": HLS, "interface": "int top(int)", "ground_truth": "leak", "inputs": ["top.c"], "metrics": ["synthesis_pass_rate"], "public": "{}", "skipped": False, "repeated": False}
_SCRIPT = "# open('inputs/no.c')\n'''open(\"inputs/none.c\")'''\nopen('inputs/top.c')\n"
_BASE_FILES = {("artifact", "README.md"): "plain", ("artifact", "metadata.json"): "{}", ("artifact", "inputs/top.c"): "old", ("tester", validation.EVALUATOR): _SCRIPT, ("tester", validation.EVALUATOR_README): "how", ("expert", "golden/top.c"): "new"}
_BASE_REQUIREMENTS = [("FR1", "functional", "adds two numbers"), ("SR1", "security", "leaks nothing")]
_BASE_MAPPING = [("FR1", "functional"), ("SR1", "security")]
_BASE_RUNS = [("golden", None, "pass", 0, _OK, ""), ("vulnerable", None, "fail", 1, _CAUGHT, ""), ("mutant", "SR1", "fail", 1, _CAUGHT, ""), ("mutant", "FR1", "fail", 1, "[TEST] FAIL: FR1", "")]
#: What each case changes: spec fields, files (None removes), requirements, mapping, runs, failed targets.
_CASES: dict[str, dict] = {
    "good": {},
    "never_run": {"runs": []},
    "domain": {"spec": {"domain_id": "nowhere"}},
    "report": {"spec": {"domain_id": RTL, "interface": "", "metrics": ["detection_rate"], "public": "CWE-1 and SR1 are its public task"}, "files": {("artifact", "submission/trojan_report.json"): "{}", ("expert", "golden/trojan_report.json"): "{1}"}},
    "simulated": {"spec": {"domain_id": SIM, "interface": "module top: registered output", "metrics": ["word_recovery_rate"]}, "files": {("artifact", "submission/recovered_rtl.v"): "x", ("expert", "golden/recovered_rtl.v"): "y"}},
    "timed": {"spec": {"domain_id": SIM, "interface": _TIMED, "metrics": ["f1"]}, "files": {("artifact", "submission/recovered_rtl.v"): "x", ("expert", "golden/recovered_rtl.v"): "x"}},
    "bare": {"spec": {"interface": " ", "ground_truth": "", "inputs": [], "metrics": []}, "files": {("expert", "golden/top.c"): None, ("artifact", "README.md"): None, ("artifact", "metadata.json"): None, ("tester", validation.EVALUATOR): None, ("tester", validation.EVALUATOR_README): None}, "requirements": [], "mapping": [], "runs": []},
    "names": {"spec": {"inputs": ["top.c", "the top file.c", "notes", "cwe_list.md"], "public": '{"objective": "avoid cwe_80, SR-2 but not sr3"}'}},
    "leaks": {"files": {("artifact", "inputs/threat-model.txt"): "CWE-5", ("artifact", "inputs/a.c"): "// cwe81 CWE-7 SR9", ("artifact", "inputs/b.c"): "sr1 and SRX"}},
    "opens": {"files": {("tester", validation.EVALUATOR): "open(f'inputs/other.c'); os.path.join('inputs', 'two.c'); Path(\"inputs\") / 'three.c'; x = \"inputs/top.c\"; print('[TEST] SKIP : SR1'); print('[TEST]SKIP:SR1')"}},
    "requirements": {"requirements": [("FR1", "functional", "meets the stated objective"), ("SR1", "security", "a"), ("SR1", "security", "b"), (" ", "security", "c"), ("SR2", "security", "d")], "mapping": [("FR1", "security"), ("SR1", ""), ("SR1", "security"), ("SR9", "security"), ("", "functional")]},
    "unsafe": {"files": {("artifact", "../up"): "", ("expert", "/golden/x"): "", ("mutant", "a/../b"): "", ("mutant", "."): ""}},
    "gone": {"files": {("artifact", "inputs/top.c"): None}},
    "twice": {"files": {("expert", "golden/sub/top.c"): "newer"}},
    "unmatched": {"files": {("expert", "golden/top.c"): None, ("expert", "golden/top.h"): "new"}},
    "equal": {"files": {("expert", "golden/top.c"): "old"}},
    "rejected": {"runs": [("golden", None, "fail", 1, "[TEST] FAIL: SR1", ""), ("vulnerable", None, "pass", 0, _OK, ""), ("mutant", "SR1", "fail", 1, _CAUGHT, "")]},
    "unnamed": {"runs": [("golden", None, "pass", 0, "[TEST] PASS: FR1\n[TEST] PASS: SR-1", ""), *_BASE_RUNS[1:]]},
    "crashed": {"runs": [_BASE_RUNS[0], ("vulnerable", None, "fail", 1, _CAUGHT, _CRASH), *_BASE_RUNS[2:]]},
    "no_gate": {"files": {("tester", validation.EVALUATOR): None, ("tester", "tests/x.py"): ""}, "runs": [("baseline", None, "fail", 1, "[TEST] FAIL: FR1", ""), ("mutant", "FR1", "fail", 1, "[TEST] FAIL: FR1", "")]},
    "other_check": {"runs": [*_BASE_RUNS[:2], ("mutant", "SR1", "fail", 1, "[TEST] FAIL: FR1", ""), ("mutant", "FR1", "fail", 1, "[TEST] FAIL: SR1", "")]},
    "dead": {"runs": [*_BASE_RUNS[:2], ("mutant", "SR1", "pass", 0, _OK, ""), ("mutant", "SR7", "fail", 1, "[TEST] FAIL: SR1", "")]},
    "broken": {"runs": [*_BASE_RUNS[:2], ("mutant", "SR1", "timeout", None, "[TEST] FAIL: SR1", ""), ("mutant", "FR1", "fail", 1, "[TEST] FAIL: FR1", _CRASH), ("mutant", "FR1", "fail", 1, "[TEST] FAIL: SETUP", "")]},
    "no_mutants": {"runs": _BASE_RUNS[:2]},
    "skipped": {"spec": {"skipped": True}, "runs": _BASE_RUNS[:2]},
    "ungenerated": {"failures": ["SR1", "FR1", "SR1"], "spec": {"repeated": True}},
}


def _case_tables() -> None:
    specs, files, requirements, mapping, runs, failures = [], [], [], [], [], []
    for task, changes in _CASES.items():
        s = _SPEC | changes.get("spec", {})
        specs.append(("" if task == "bare" else task, s["domain_id"], s["interface"], s["ground_truth"], s["inputs"], s["metrics"], s["public"], s["skipped"], s["repeated"]))
        task = "" if task == "bare" else task
        files += [(task, bundle, path, content) for (bundle, path), content in (_BASE_FILES | changes.get("files", {})).items() if content is not None]
        requirements += [(task, *r) for r in changes.get("requirements", _BASE_REQUIREMENTS)]
        mapping += [(task, *m) for m in changes.get("mapping", _BASE_MAPPING)]
        runs += [(task, *r) for r in changes.get("runs", _BASE_RUNS)]
        failures += [(task, target) for target in changes.get("failures", [])]
    TABLES["specs"] = ("task_id string; domain_id string; interface string; ground_truth string; input_artifacts array<string>; metrics array<string>; public_text string; mutants_skipped boolean; repeated_failure boolean", specs)
    TABLES["files"] = ("task_id string; bundle string; path string; content string", files)
    TABLES["requirements"] = ("task_id string; req_id string; req_type string; text string", requirements)
    TABLES["mapping"] = ("task_id string; requirement_id string; requirement_type string", mapping)
    TABLES["runs"] = ("task_id string; arm string; target string; status string; returncode int; stdout string; stderr string", runs)
    TABLES["failures"] = ("task_id string; target string", failures)
    TABLES["domains"] = ("domain_id string; submission_kind string; evaluation_mode string; metrics array<string>; submission_artifacts array<string>", list(validation.DOMAINS))


_case_tables()
CASE_TABLES = ["specs", "domains", "requirements", "mapping", "files", "runs", "failures"]

_DIFF_SQL = r"""
    rq AS (SELECT task_id, list(DISTINCT trim(req_id)) FILTER (trim(req_id) <> '') AS ids FROM requirements GROUP BY 1),
    rn AS (SELECT *, list_distinct(list_filter(regexp_extract_all(coalesce(stdout, ''), '\[TEST\]\s+FAIL:\s+([\w-]+)', 1), lambda x: x <> 'SETUP')) AS failed,
                  list_filter(regexp_extract_all(coalesce(stdout, ''), '\[TEST\]\s+(?:PASS|FAIL):\s+([\w-]+)', 1), lambda x: x <> 'SETUP') AS seen,
                  contains(coalesce(stdout, ''), '[TEST] FAIL: SETUP') AS setup, contains(coalesce(stderr, ''), 'Traceback (most recent call last)') AS crash FROM runs),
    df AS (SELECT g.task_id, g.seen, g.status AS gs, v.status AS vs, coalesce(ids, []) AS ids, g.status = 'pass' AND len(g.failed) = 0 AND NOT g.setup AND NOT g.crash AND list_has_all(g.seen, coalesce(ids, [])) AS golden_ok,
                  v.status = 'fail' AND len(v.failed) > 0 AND (len(coalesce(ids, [])) = 0 OR list_has_any(v.failed, ids)) AND NOT v.setup AND NOT v.crash AS vulnerable_ok,
                  g.setup OR v.setup AS setup, g.crash OR v.crash AS crash
           FROM rn g JOIN rn v ON v.task_id = g.task_id AND v.arm = 'vulnerable' LEFT JOIN rq ON rq.task_id = g.task_id WHERE g.arm = 'golden')"""

_OVERLAY_SQL = r"""
    tg AS (SELECT task_id, unnest(CASE WHEN submission_kind = 'hardened_artifact' THEN list_transform(list_filter(input_artifacts, lambda f: regexp_matches(f, '\.(cpp|cc|c|h|hpp|v|sv|vhd|py|tcl)$')), lambda f: 'inputs/' || f)
                                  ELSE list_transform(submission_artifacts, lambda f: 'submission/' || f) END) AS target FROM specs JOIN domains USING (domain_id)),
    gf AS (SELECT task_id, regexp_extract(path, '[^/]*$') AS name, count(*) AS n, min(content) AS golden FROM files WHERE bundle = 'expert' AND list_contains(string_split(path, '/'), 'golden') GROUP BY ALL),
    pl AS (SELECT tg.*, CASE WHEN f.path IS NULL THEN 'absent' WHEN n > 1 THEN 'ambiguous' WHEN n IS NULL THEN 'unmapped' WHEN golden = f.content THEN 'same' ELSE 'mapped' END AS state
           FROM tg LEFT JOIN (SELECT * FROM files WHERE bundle <> 'mutant') f ON f.task_id = tg.task_id AND f.path = target LEFT JOIN gf ON gf.task_id = tg.task_id AND name = regexp_extract(target, '[^/]*$'))"""

_MUTATION_SQL = r"""
    ev AS (SELECT task_id FROM files WHERE bundle = 'tester' AND path = 'evaluation/evaluate.py'),
    fs AS (SELECT s.task_id, CASE WHEN s.task_id IN (SELECT task_id FROM pl WHERE state IN ('same', 'mapped')) AND g.status IS NOT NULL THEN g.status ELSE b.status END AS first
           FROM specs s LEFT JOIN runs g ON g.task_id = s.task_id AND g.arm = 'golden' LEFT JOIN runs b ON b.task_id = s.task_id AND b.arm = 'baseline'),
    mp AS (SELECT DISTINCT task_id, trim(requirement_id) AS id FROM mapping WHERE trim(requirement_id) <> ''),
    mu AS (SELECT rn.*, coalesce(status <> 'pass' AND (status IN ('error', 'timeout') OR setup OR crash OR len(failed) = 0), false) AS broke FROM rn WHERE arm = 'mutant'),
    ju AS (SELECT mu.* FROM mu JOIN mp ON mp.task_id = mu.task_id AND mp.id = mu.target JOIN fs ON fs.task_id = mu.task_id WHERE first = 'pass' AND mu.task_id IN (FROM ev)),
    st AS (SELECT mp.*, (SELECT count(*) FROM ju WHERE ju.task_id = mp.task_id AND target = id) AS targeting, (SELECT count(*) FROM ju WHERE ju.task_id = mp.task_id AND target = id AND NOT broke AND list_contains(failed, id)) AS detected,
                  (SELECT count(*) FROM ju WHERE ju.task_id = mp.task_id AND list_contains(failed, id)) AS activation
           FROM mp WHERE (mp.task_id IN (SELECT task_id FROM fs WHERE first = 'pass') AND mp.task_id IN (FROM ev)) OR mp.task_id NOT IN (SELECT task_id FROM mu))"""

_ISSUES_SQL = rf"""{_DIFF_SQL}, {_OVERLAY_SQL}, {_MUTATION_SQL},
    kn AS (SELECT s.*, submission_kind, evaluation_mode, d.metrics AS dm FROM specs s JOIN domains d USING (domain_id)),
    ran AS (SELECT DISTINCT task_id FROM runs), live AS (SELECT task_id FROM specs WHERE NOT mutants_skipped AND task_id IN (FROM ran)),
    ia AS (SELECT s.task_id, submission_kind, unnest(input_artifacts) AS name FROM specs s LEFT JOIN domains d USING (domain_id)),
    sc AS (SELECT task_id, regexp_replace(regexp_replace(regexp_replace(content, '(?s)''''''.*?''''''', '', 'g'), '(?s)"{{3}}.*?"{{3}}', '', 'g'), '(?m)#.*$', '', 'g') AS code, content FROM files WHERE bundle = 'tester' AND path = 'evaluation/evaluate.py'),
    op AS (SELECT DISTINCT task_id, name FROM (SELECT task_id, unnest(list_concat(regexp_extract_all(code, 'open\s*\(\s*[''"f]?(?:f?[''"])?inputs/([\w.\-]+)', 1), regexp_extract_all(code, 'os\.path\.join\s*\(\s*[''"]inputs[''"]\s*,\s*[''"]([\w.\-]+)[''"]', 1),
                 regexp_extract_all(code, 'Path\s*\(\s*[''"]inputs[''"]\s*\)\s*/\s*[''"]([\w.\-]+)[''"]', 1), regexp_extract_all(code, '[''"]inputs/([\w.\-]+)[''"]', 1))) AS name FROM sc) WHERE contains(name, '.')),
    rr AS (SELECT task_id, trim(req_id) AS id, max(req_type) AS kind, count(*) AS n FROM requirements WHERE trim(req_id) <> '' GROUP BY ALL),
    mm AS (SELECT task_id, trim(requirement_id) AS id, trim(requirement_type) AS kind FROM mapping WHERE trim(requirement_id) <> ''),
    tok AS (SELECT '(?i)\bCWE[-_]?\d+\b' AS cwe, '\bSR-?\d+\b' AS sr, '(?i)security[_-]?spec|cwe|threat[_-]?model|security[_-]?requirement' AS named),
    uf AS (SELECT DISTINCT task_id, bundle, path, 0 AS i FROM files WHERE bundle <> 'mutant' UNION ALL SELECT task_id, bundle, path, row_number() OVER () FROM files WHERE bundle = 'mutant'),
    x AS (
      SELECT task_id, 'unknown_domain' AS issue FROM specs WHERE domain_id NOT IN (SELECT domain_id FROM domains)
      UNION ALL SELECT task_id, 'unknown_domain' FROM specs WHERE domain_id NOT IN (SELECT domain_id FROM domains) AND task_id IN (FROM ran)
      UNION ALL SELECT task_id, 'missing_case_file' FROM specs, (VALUES ('README.md'), ('metadata.json')) q(p) WHERE NOT EXISTS (FROM files f WHERE f.task_id = specs.task_id AND bundle = 'artifact' AND path = p)
      UNION ALL SELECT task_id, 'missing_task_id' FROM specs WHERE task_id = ''
      UNION ALL SELECT task_id, 'missing_input_artifacts' FROM specs WHERE len(input_artifacts) = 0
      UNION ALL SELECT task_id, 'input_artifact_not_filename' FROM ia WHERE contains(name, ' ') OR NOT regexp_matches(name, '\.(cpp|c|h|v|sv|json|md|txt|tcl|yaml|py|vhd|lib)$')
      UNION ALL SELECT task_id, 'missing_ground_truth' FROM specs WHERE ground_truth = '' AND task_id NOT IN (SELECT task_id FROM files WHERE bundle = 'expert')
      UNION ALL SELECT task_id, 'missing_interface' FROM kn WHERE submission_kind = 'hardened_artifact' AND trim(interface) = ''
      UNION ALL SELECT task_id, 'missing_timing_discipline' FROM kn WHERE evaluation_mode = 'simulate' AND (trim(interface) = '' OR NOT regexp_matches(interface, '(?i)\b(moore|mealy|registered|combinational|clocked|sequential)\b') OR NOT regexp_matches(interface, '(?i)\b(cycles?|(clock|rising|falling) edge|(pos|neg)[- ]?edge|latency)\b'))
      UNION ALL SELECT task_id, 'public_security_leak' FROM ia, tok WHERE submission_kind = 'hardened_artifact' AND regexp_matches(name, named)
      UNION ALL SELECT task_id, 'public_security_leak' FROM kn, tok WHERE submission_kind = 'hardened_artifact' AND (regexp_matches(public_text, cwe) OR regexp_matches(public_text, sr))
      UNION ALL SELECT f.task_id, 'public_security_leak' FROM files f JOIN kn USING (task_id), tok WHERE submission_kind = 'hardened_artifact' AND bundle = 'artifact' AND (regexp_matches(regexp_extract(path, '[^/]*$'), named) OR regexp_matches(content, cwe) OR regexp_matches(content, sr))
      UNION ALL SELECT task_id, 'missing_functional_requirements' FROM specs WHERE task_id NOT IN (SELECT task_id FROM requirements WHERE req_type = 'functional')
      UNION ALL SELECT task_id, 'generic_functional_requirement' FROM requirements WHERE req_type = 'functional' GROUP BY 1 HAVING count(*) = 1 AND bool_or(regexp_matches(text, '(?i)satisfies the (public )?objective|meets the (stated )?objective'))
      UNION ALL SELECT task_id, 'missing_metrics' FROM specs WHERE len(metrics) = 0
      UNION ALL SELECT task_id, 'domain_metric_mismatch' FROM kn WHERE len(metrics) > 0 AND NOT list_has_any(metrics, dm)
      UNION ALL SELECT task_id, 'missing_evaluator' FROM specs WHERE task_id NOT IN (FROM ev)
      UNION ALL SELECT task_id, 'missing_evaluator_readme' FROM specs WHERE task_id NOT IN (SELECT task_id FROM files WHERE bundle = 'tester' AND path = 'evaluation/README.md')
      UNION ALL SELECT task_id, 'evaluator_opens_undeclared_file' FROM op WHERE NOT EXISTS (FROM ia WHERE ia.task_id = op.task_id AND ia.name = op.name)
      UNION ALL SELECT task_id, 'evaluator_skips_requirement' FROM (SELECT task_id, unnest(regexp_extract_all(content, '\[TEST\]\s*SKIP\s*:\s*([\w-]+)', 1)) FROM sc)
      UNION ALL SELECT task_id, 'duplicate_requirement_id' FROM rr WHERE n > 1
      UNION ALL SELECT task_id, 'missing_requirement_id' FROM requirements WHERE trim(req_id) = ''
      UNION ALL SELECT task_id, 'missing_requirement_map' FROM specs WHERE task_id NOT IN (SELECT task_id FROM mapping)
      UNION ALL SELECT task_id, 'duplicate_requirement_mapping' FROM mm GROUP BY task_id, id HAVING count(*) > 1
      UNION ALL SELECT mm.task_id, 'unknown_requirement_mapping' FROM mm LEFT JOIN rr USING (task_id, id) WHERE rr.n IS NULL
      UNION ALL SELECT mm.task_id, 'requirement_type_mismatch' FROM mm JOIN rr USING (task_id, id) WHERE mm.kind <> '' AND mm.kind <> rr.kind
      UNION ALL SELECT rr.task_id, 'missing_requirement_harness' FROM rr WHERE NOT EXISTS (FROM mm WHERE mm.task_id = rr.task_id AND mm.id = rr.id)
      UNION ALL SELECT task_id, 'unsafe_output_path' FROM uf WHERE path = '' OR path = '.' OR starts_with(path, '/') OR list_contains(string_split(path, '/'), '..')
      UNION ALL SELECT task_id, 'submission_target_missing' FROM pl WHERE state = 'absent' AND task_id IN (FROM ran)
      UNION ALL SELECT task_id, 'golden_overlay_ambiguous' FROM pl WHERE state = 'ambiguous' AND task_id IN (FROM ran)
      UNION ALL SELECT task_id, 'golden_overlay_missing' FROM kn WHERE task_id IN (FROM ran) AND task_id NOT IN (SELECT task_id FROM pl WHERE state IN ('same', 'mapped'))
      UNION ALL SELECT task_id, 'golden_equals_baseline' FROM pl WHERE task_id IN (FROM ran) GROUP BY 1 HAVING bool_or(state = 'same') AND NOT bool_or(state = 'mapped')
      UNION ALL SELECT task_id, 'golden_rejected' FROM df WHERE NOT golden_ok
      UNION ALL SELECT task_id, 'requirement_id_mismatch' FROM df WHERE EXISTS (FROM mp WHERE mp.task_id = df.task_id AND NOT list_contains(seen, id))
      UNION ALL SELECT task_id, CASE WHEN vs = 'pass' THEN 'vulnerable_accepted' ELSE 'vulnerable_rejection_invalid' END FROM df WHERE NOT vulnerable_ok
      UNION ALL SELECT task_id, 'baseline_failed' FROM fs WHERE first <> 'pass' AND task_id NOT IN (SELECT task_id FROM df) AND task_id IN (SELECT task_id FROM mu)
      UNION ALL SELECT task_id, 'dead_check' FROM st WHERE targeting > 0 AND activation = 0 AND task_id IN (FROM live)
      UNION ALL SELECT task_id, 'uncovered_requirement' FROM st WHERE targeting > 0 AND detected = 0 AND task_id IN (FROM live)
      UNION ALL SELECT task_id, 'untested_requirement' FROM st WHERE targeting = 0 AND task_id IN (FROM live)
      UNION ALL SELECT DISTINCT task_id, 'mutation_execution_error' FROM ju WHERE broke AND task_id IN (FROM live)
      UNION ALL SELECT DISTINCT task_id, 'mutation_generation_failure' FROM failures WHERE task_id IN (FROM ran)
      UNION ALL SELECT task_id, 'repeated_preflight_failure' FROM specs WHERE repeated_failure)"""


def _validated(t) -> DataFrame:
    return validation.validate(*(t(name) for name in CASE_TABLES))


@_query(CASE_TABLES, _ISSUES_SQL + " SELECT task_id, issue, count(*) AS n FROM x GROUP BY ALL")
def q_validation_issues(t):
    return _validated(t).groupBy("task_id", "issue").agg(F.count("*").alias("n"))


@_query(CASE_TABLES, _ISSUES_SQL + " SELECT s.task_id, count(x.issue)::BIGINT AS n_issues, CASE WHEN count(x.issue) = 0 THEN 'pass' ELSE 'fail' END AS status FROM specs s LEFT JOIN x USING (task_id) GROUP BY 1")
def q_validation_report(t):
    return validation.report(t("specs"), _validated(t))


@_query(["requirements", "runs"], _DIFF_SQL + """ SELECT task_id, coalesce(golden_ok, false) AS golden_ok, coalesce(vulnerable_ok, false) AS vulnerable_ok, CASE WHEN golden_ok AND vulnerable_ok THEN 'pass' ELSE 'fail' END AS status,
    CASE WHEN golden_ok AND vulnerable_ok THEN NULL WHEN gs IN ('error', 'timeout') OR vs IN ('error', 'timeout') THEN 'runner_error' WHEN setup THEN 'setup_error' WHEN crash THEN 'evaluator_error'
         WHEN NOT golden_ok AND NOT vulnerable_ok THEN 'multiple' WHEN NOT golden_ok THEN 'golden_rejected' ELSE 'vulnerable_accepted' END AS failure_class FROM df""")
def q_differential(t):
    return validation.differential(t("runs"), t("requirements")).select("task_id", "golden_ok", "vulnerable_ok", "status", "failure_class")


@_query(["specs", "domains", "mapping", "requirements", "files", "runs"], f"{_DIFF_SQL}, {_OVERLAY_SQL}, {_MUTATION_SQL}" + """ SELECT mu.task_id, count_if(NOT broke)::BIGINT AS valid, count_if(NOT broke AND list_contains(failed, target))::BIGINT AS kills, count_if(broke)::BIGINT AS error_runs,
    coalesce(round_even(count_if(NOT broke AND list_contains(failed, target)) / nullif(count_if(NOT broke), 0), 3), 0) AS mutation_score FROM mu JOIN mp ON mp.task_id = mu.task_id AND mp.id = target GROUP BY 1""")
def q_mutation_score(t):
    return validation.mutation(t("runs"), t("mapping"))[1]


@_query(["specs", "domains", "files"], _OVERLAY_SQL + " SELECT DISTINCT task_id, target, state FROM pl")
def q_overlays(t):
    return validation.overlays(t("files"), validation.submission_targets(t("specs"), t("domains")))


@_query(CASE_TABLES, _ISSUES_SQL + """, r AS (SELECT DISTINCT x.task_id, issue, df.golden_ok AND df.vulnerable_ok AND x.task_id IN (SELECT task_id FROM failures) AS mutants_only FROM x LEFT JOIN df USING (task_id))
    SELECT task_id, issue, CASE WHEN mutants_only THEN 'mutants' WHEN issue IN ('missing_interface', 'missing_timing_discipline', 'missing_functional_requirements', 'generic_functional_requirement') THEN 'specification'
           WHEN issue IN ('missing_input_artifacts', 'missing_ground_truth', 'public_security_leak') THEN 'case_artifacts'
           WHEN issue IN ('evaluator_opens_undeclared_file', 'input_artifact_not_filename', 'evaluator_skips_requirement', 'missing_requirement_harness', 'golden_rejected', 'vulnerable_accepted', 'requirement_id_mismatch', 'baseline_failed', 'dead_check', 'uncovered_requirement') THEN 'evaluation_framework'
           ELSE 'none' END AS artifact FROM r""")
def q_issue_routes(t):
    gate = validation.differential(t("runs"), t("requirements"))
    return validation.routed(_validated(t), t("failures").distinct(), gate).select("task_id", "issue", "artifact").distinct()


@_query(["files"], r"""s AS (SELECT task_id, regexp_replace(regexp_replace(content, '(?s)''''''.*?''''''', '', 'g'), '(?m)#.*$', '', 'g') AS c FROM files WHERE path = 'evaluation/evaluate.py')
    SELECT task_id, array_to_string(list_sort(list_distinct(regexp_extract_all(c, 'inputs(?:/|[''"]\)? ?[,/] ?[''"])([\w.]+)', 1))), ' ') AS opened FROM s""")
def q_opened_files(t):
    scripts = t("files").where(F.col("path") == validation.EVALUATOR)
    return scripts.select("task_id", F.array_join(F.array_sort(validation.opened_files(F.col("content"))), " ").alias("opened"))


@_query(["files"], """SELECT task_id, path, content FROM files WHERE bundle = 'artifact' AND (starts_with(path, 'inputs/') OR starts_with(path, 'submission/'))""")
def q_public_files(t):
    own = t("files").where(F.col("bundle") == "artifact").select(F.col("task_id").alias("case"), "path", F.col("content").cast("binary").alias("content"))
    return sources.public_files(own).select(F.col("case").alias("task_id"), "path", F.col("content").cast("string").alias("content"))


@_query(["files"], r"""SELECT DISTINCT path, regexp_matches(path, '^(golden|expert|tests|evaluation|mutants|reports|spec|artifacts)(/|$)|(^|/)(case|run)_manifest\.json$') AS private, NOT regexp_matches(path, '(^|/)(mutant_[^/]*|golden|ground_truth|expert|mutants|reports|artifacts)(/|$)') AS seen FROM files""")
def q_private_paths(t):
    path = F.col("path")
    return t("files").select("path", sources.is_private(path).alias("private"), sources.evaluator_sees(path).alias("seen")).distinct()


# repair rounds and pre-flight attempts, with exact ties and nulls

_S = "validation_status differential_status analyzer_status baseline_status".split()
TABLES["rounds"] = (
    "; ".join(["task_id string", "round int", *(f"{c} string" for c in _S), "mutation_score double", "mapping_coverage double", "coverage double", "discrimination_coverage double", "n_issues int"]),
    [("tie", 0, "fail", "pass", "pass", "pass", 0.5, 0.8, None, 0.1, 3), ("tie", 1, "fail", "pass", "warning", "pass", 0.5004, None, 0.8, 0.1, 3), ("tie", 2, "fail", "pass", "fail", "pass", 1.0, 1.0, None, 1.0, 0),
     ("clean", 0, "pass", None, None, None, None, None, None, None, None), ("clean", 1, "fail", "pass", "pass", "pass", 1.0, 1.0, 1.0, 1.0, 0), ("gate", 0, "fail", None, "pass", "pass", 1.0, 1.0, None, 1.0, 0), ("gate", 1, "fail", "pass", None, None, 0.0, 0.0, None, None, 9),
     ("score", 0, "fail", "fail", "pass", "pass", 0.6, 0.1, None, 0.0, 5), ("score", 1, "fail", "fail", "pass", "pass", 0.59, 1.0, None, 1.0, 1), ("issues", 0, "fail", "fail", "fail", "fail", 0.0, 0.0, None, None, 2), ("issues", 1, "fail", "fail", "fail", "fail", None, None, None, 0.0, 7)],
)


@_query(["rounds"], """SELECT task_id, round FROM rounds QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY CASE WHEN validation_status = 'pass' THEN 0 ELSE 1 END, CASE WHEN differential_status = 'pass' THEN 0 ELSE 1 END,
    CASE WHEN analyzer_status IN ('pass', 'warning') THEN 0 ELSE 1 END, CASE WHEN baseline_status = 'pass' THEN 0 ELSE 1 END, round_even(coalesce(mutation_score, 0), 3) DESC, round_even(coalesce(mapping_coverage, coverage, 0), 3) DESC,
    round_even(coalesce(discrimination_coverage, 0), 3) DESC, coalesce(n_issues, 0), round DESC) = 1""")
def q_best_round(t):
    rounds = t("rounds")
    values = F.struct(*[c for c in rounds.columns if c not in ("task_id", "round")])
    return ranking.best_round(rounds, ["task_id"], ranking.round_rank(values), "round").select("task_id", "round")


_A, _B = {"ok": True, "status": "pass", "stdout": _OK, "stderr": ""}, {"ok": False, "status": "fail", "stdout": _CAUGHT, "stderr": None}
_N = {"ok": None, "status": None, "stdout": None, "stderr": None}
_ARM = "struct<ok:boolean,status:string,stdout:string,stderr:string>"
TABLES["attempts"] = (
    f"task_id string; attempt int; failure_class string; failure_signature string; golden {_ARM}; vulnerable {_ARM}",
    [("tie", 1, "multiple", "a", _B, _B), ("tie", 2, "multiple", "b", _B, _B), ("tie", 3, "multiple", "b", _B, _B), ("tie", 4, "multiple", "c", _A, _B), ("golden", 1, "vulnerable_accepted", "x", _A, _A), ("golden", 2, "golden_rejected", "x", _B, _B | {"ok": True}),
     ("passes", 1, "multiple", "", _B | {"stdout": "[TEST] PASS: A\n[TEST] PASS: B\n[TEST] FAIL: C"}, _N), ("passes", 2, "multiple", "", _B | {"stdout": "[TEST] PASS: A"}, _A), ("passes", 3, "runner_error", "r", _B | {"stderr": _CRASH}, _A), ("passes", 4, "multiple", "", _A, _A),
     ("usable", 1, "setup_error", "s", _B | {"stdout": "x", "stderr": _CRASH}, _B), ("usable", 2, "setup_error", "t", _B | {"stdout": "x", "stderr": " late\n warning "}, _B), ("usable", 3, None, "u", _N, _N | {"status": "fail", "stdout": "[TEST] FAIL: SR1"}),
     ("silent", 1, "multiple", "", _N, _N), ("silent", 2, "multiple", "", _N, _B | {"stdout": "said [TEST] FAIL: no\n  [TEST] FAIL: SR2 \n[TEST] FAIL: SETUP broke"})],
)
_SAID = "coalesce({0}.stdout, '') || chr(10) || coalesce({0}.stderr, '')"


@_query(["attempts"], f"""x AS (SELECT *, {_SAID.format("golden")} AS g, {_SAID.format("vulnerable")} AS v, 'Traceback (most recent call last)' AS crash, '[TEST] FAIL: SETUP' AS broken FROM attempts)
    SELECT task_id, attempt FROM x QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY coalesce(golden.ok, false) DESC, len(string_split(g, '[TEST] PASS:')) DESC, len(string_split(g, '[TEST] FAIL:')), coalesce(golden.status = 'pass', false) DESC,
    coalesce(golden.status IN ('pass', 'fail'), false) AND NOT contains(g, crash) AND NOT contains(g, broken) DESC, coalesce(vulnerable.ok, false) DESC,
    coalesce(vulnerable.status = 'fail', false) AND contains(v, '[TEST] FAIL:') AND NOT contains(v, broken) AND NOT contains(v, crash) DESC, attempt) = 1""")
def q_best_attempt(t):
    return ranking.best_round(t("attempts"), ["task_id"], ranking.preflight_rank(F.col("golden"), F.col("vulnerable")), "attempt", later_wins=False).select("task_id", "attempt")


@_query(["attempts"], """x AS (SELECT *, coalesce(failure_class IN ('submission_invariant', 'runner_error'), false) OR coalesce(failure_signature <> '' AND failure_signature = lag(failure_signature) OVER (PARTITION BY task_id ORDER BY attempt), false) AS stopped FROM attempts)
    SELECT task_id, attempt, stopped FROM x WHERE NOT EXISTS (FROM x y WHERE y.task_id = x.task_id AND y.attempt < x.attempt AND y.stopped)""")
def q_attempts_until_stop(t):
    final = F.col("failure_class").isin(ranking.NOT_REPAIRABLE)
    return ranking.until_repeat(t("attempts").select("task_id", "attempt", "failure_class", "failure_signature"), ["task_id"], ["attempt"], "failure_signature", final).select("task_id", "attempt", "stopped")


_LINES = "list_filter(list_transform(string_split(coalesce({0}, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@_query(["attempts"], f"""r AS (SELECT task_id, attempt, 1 AS nth, golden AS r FROM attempts UNION ALL SELECT task_id, attempt, 2, vulnerable FROM attempts),
    l AS (SELECT *, {_LINES.format("r.stderr")} AS e, {_LINES.format("r.stdout")} AS o FROM r),
    c AS (SELECT task_id, attempt, nth, coalesce(CASE WHEN contains(r.stderr, 'Traceback (most recent call last)') THEN e[-1] ELSE e[1] END, list_filter(o, lambda x: starts_with(x, '[TEST] FAIL: SETUP'))[1], list_filter(o, lambda x: starts_with(x, '[TEST] FAIL:'))[1]) AS line FROM l)
    SELECT task_id, attempt, coalesce(arg_min(line, nth) FILTER (line IS NOT NULL), 'no actionable evaluator output was emitted') AS line FROM c GROUP BY ALL""")
def q_diagnostic_line(t):
    return t("attempts").select("task_id", "attempt", text.diagnostic_line(F.col("golden"), F.col("vulnerable")).alias("line"))


# records

_FILE = "array<struct<path:string,content:string>>"
TABLES["bundles"] = (
    f"task_id string; files {_FILE}; repaired {_FILE}; declared array<string>; allowed array<string>; key_name string",
    [("a", [{"path": "inputs/a.c", "content": "1"}, {"path": "inputs/b.h", "content": "2"}, {"path": "inputs/a.c", "content": "3"}], [{"path": "inputs/b.h", "content": "9"}, {"path": "new", "content": "0"}], ["b.h", "a.c", "a.c"], ["inputs"], "threat_model"),
     ("b", [{"path": "README.md", "content": "r"}, {"path": "inputs", "content": ""}], [{"path": "README.md", "content": "q"}], ["x.c"], ["inputs", "README.md"], ""), ("c", [{"path": "inputs/x/y.v", "content": "y"}], [], None, ["submission/"], "a__b")],
)


@_query(["bundles"], """f AS (SELECT task_id, unnest(files) AS f, generate_subscripts(files, 1) AS i FROM bundles), l AS (SELECT task_id, f.path AS path, arg_max(f.content, i) AS content FROM f GROUP BY ALL)
    SELECT task_id, string_agg(path || '=' || content, ';' ORDER BY path) AS files FROM l GROUP BY 1""")
def q_file_map(t):
    entries = F.array_sort(F.map_entries(records.file_map(F.col("files"))))
    return t("bundles").select("task_id", F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";").alias("files"))


@_query(["bundles"], """f AS (SELECT task_id, f.path AS path, f.content AS content, 0 AS i FROM (SELECT task_id, unnest(files) AS f FROM bundles) UNION ALL SELECT task_id, f.path, f.content, 1 FROM (SELECT task_id, unnest(repaired) AS f FROM bundles)),
    l AS (SELECT task_id, path, arg_max(content, i) FILTER (i = 1) AS later, i FROM f GROUP BY ALL), p AS (SELECT DISTINCT task_id, path, max(later) OVER (PARTITION BY task_id, path) AS later FROM l)
    SELECT task_id, path, later IS NOT NULL AS replaced FROM p""")
def q_overlaid_paths(t):
    over = records.file_map(F.col("repaired"))
    merged = bundles.overlaid(records.file_map(F.col("files")), over)
    return t("bundles").select("task_id", F.explode(F.map_keys(merged)).alias("path"), over.alias("over")).select("task_id", "path", F.map_contains_key("over", F.col("path")).alias("replaced"))


@_query(["bundles"], """SELECT task_id, array_to_string(list_transform(files, lambda f: f.path || '=' || coalesce(list_filter(repaired, lambda r: r.path = f.path)[1].content, f.content)), ';') AS files FROM bundles""")
def q_replaced_in_place(t):
    files = bundles.replaced_in_place(F.col("files"), records.file_map(F.col("repaired")))
    return t("bundles").select("task_id", F.array_join(F.transform(files, lambda f: F.concat_ws("=", f["path"], f["content"])), ";").alias("files"))


@_query(["bundles"], r"""s AS (SELECT task_id, declared, list_transform(list_filter(files, lambda f: starts_with(f.path, 'inputs/')), lambda f: regexp_extract(f.path, '[^/]*$')) AS shipped FROM bundles)
    SELECT task_id, array_to_string(CASE WHEN len(shipped) = 0 OR list_sort(list_distinct(shipped)) = list_sort(list_distinct(coalesce(declared, []))) THEN declared ELSE shipped END, ' ') AS inputs FROM s""")
def q_reconciled_inputs(t):
    return t("bundles").select("task_id", F.array_join(records.reconciled(F.col("declared"), F.col("files")), " ").alias("inputs"))


@_query(["bundles"], r"""SELECT task_id, nullif(array_to_string(list_transform(list_filter(files, lambda f: len(list_filter(allowed, lambda a: f.path = a OR starts_with(f.path, rtrim(a, '/') || '/'))) > 0), lambda f: f.path), ' '), '') AS kept FROM bundles""")
def q_manifest_scope(t):
    kept = records.in_scope(F.col("files"), F.col("allowed"))
    return t("bundles").select("task_id", F.array_join(F.transform(kept, lambda f: f["path"]), " ").alias("kept"))


@_query(["bundles"], "SELECT task_id, replace(key_name, '_', ' ') AS title FROM bundles")
def q_key_title(t):
    return t("bundles").select("task_id", text.key_title(F.col("key_name")).alias("title"))


TABLES["trace"] = (
    "trial_id string; seq int; secret_operand long; cycle_index int; mul_en int; done int",
    [("t1", i, 7, i, int(i in (1, 3, 9)), int(i == 8)) for i in range(1, 11)] + [("t2", 20 + i, 7, i, 1, int(i == 5)) for i in range(1, 9)] + [("t3", 40 + i, 12, i, int(i % 2), int(i in (6, 8))) for i in range(1, 9)] + [("t4", 60, 0, 0, 1, 0)],
)


@_query(["trace"], """f AS (SELECT secret_operand, arg_min(trial_id, seq) AS trial_id FROM trace GROUP BY 1)
    SELECT secret_operand, count_if(cycle_index BETWEEN 1 AND 8 AND mul_en = 1)::BIGINT AS enable_count, bit_count(secret_operand)::INTEGER AS weight, coalesce(string_agg(DISTINCT cycle_index::VARCHAR, ' ' ORDER BY cycle_index::VARCHAR) FILTER (done = 1), '') AS done_cycles,
           coalesce(count(DISTINCT cycle_index) FILTER (done = 1) = 1 AND bool_or(done = 1 AND cycle_index = 8), false) AS steady FROM trace JOIN f USING (secret_operand, trial_id) GROUP BY 1""")
def q_enable_counts(t):
    return records.enable_counts(t("trace")).withColumn("done_cycles", F.array_join(F.col("done_cycles").cast("array<string>"), " "))


_CALL = "kind string; blank boolean; degenerate boolean; reasoning boolean; format boolean; observed int; requested int; cap int; affordable int; reductions int; overflow boolean; account_code int; attempt int; retries int"
_DEFAULT = {"kind": None, "blank": False, "degenerate": False, "reasoning": False, "format": False, "observed": 100, "requested": 100, "cap": 400, "affordable": None, "reductions": 0, "overflow": False, "account_code": None, "attempt": 0, "retries": 2}
#: Answers of every kind with what must follow them.
_ANSWERS = [
    ({}, None), ({"kind": "truncated", "blank": True, "reasoning": True, "degenerate": True}, "retry_without_reasoning"), ({"kind": "truncated", "reasoning": True, "degenerate": True, "observed": 1}, "stop_degenerate"),
    ({"kind": "truncated", "observed": 89}, "retry_early_cut"), ({"kind": "truncated", "observed": 89, "attempt": 2}, "stop_early_cut"), ({"kind": "truncated", "observed": 90}, "double"), ({"kind": "truncated", "observed": None, "cap": 100}, "stop_at_cap"),
    ({"kind": "filtered"}, "retry_filtered"), ({"kind": "filtered", "attempt": 2}, "stop_filtered"), ({"kind": "empty", "reasoning": True, "format": True}, "retry_without_reasoning"), ({"kind": "empty", "format": True, "attempt": 2}, "retry_without_format"),
    ({"kind": "empty"}, "retry_empty"), ({"kind": "empty", "attempt": 2}, "stop_empty"), ({"kind": "error", "affordable": 99, "overflow": True}, "retry_error_"), ({"kind": "error", "affordable": 300, "requested": 400, "account_code": 402}, "lower_to_affordable"),
    ({"kind": "error", "affordable": 300, "requested": 400, "account_code": 402, "reductions": 3}, "stop_account"), ({"kind": "error", "overflow": True, "account_code": 401}, "stop_overflow"), ({"kind": "error", "account_code": 500}, "retry_error"), ({"kind": "error", "attempt": 3}, "stop_error"),
]
_ANSWERS[13] = ({"kind": "error", "affordable": 99, "requested": 100}, "retry_error")  # too little to go on with
TABLES["calls"] = ("nth int; follows string; " + _CALL, [(n, want, *(_DEFAULT | given).values()) for n, (given, want) in enumerate(_ANSWERS)])


@_query(["calls"], "SELECT nth, follows FROM calls")
def q_retry_decision(t):
    calls = t("calls")
    call = F.struct(*[c for c in calls.columns if c not in ("nth", "follows")])
    return calls.select("nth", records.retry_decision(call).alias("follows"))


TABLES["budgets"] = (
    "nth int; most int; base int; reasoning int; active boolean; override_tokens int; agent_tokens int; default_tokens int; retained boolean; artifact string",
    [(1, 8000, 3000, 0, False, None, None, None, None, None), (2, 8000, 3000, 500, True, 1, 2, 3, True, "specification"), (3, 5000, 3000, 500, True, None, 2, 3, False, "none"), (4, 2000, 3000, 9, False, None, None, 3, False, "mutants"), (5, 8000, 3000, None, None, None, None, None, False, None)],
)


@_query(["budgets"], """SELECT nth, least(most, (base + CASE WHEN active THEN coalesce(reasoning, 0) ELSE 0 END) * CASE WHEN active THEN 2 ELSE 1 END) AS plan_tokens, coalesce(override_tokens, agent_tokens, default_tokens, 16000) AS tokens, 2.0 * power(2, nth - 1) AS wait_s,
    CASE WHEN retained THEN 'retained' WHEN coalesce(artifact, 'none') = 'none' THEN 'nothing_to_revise' END AS stop FROM budgets""")
def q_budgets_and_stops(t):
    plan = records.plan_budget(F.col("most"), F.col("base"), F.col("reasoning"), F.col("active"))
    tokens = records.token_limit(F.col("override_tokens"), F.col("agent_tokens"), F.col("default_tokens"))
    return t("budgets").select("nth", plan.alias("plan_tokens"), tokens.alias("tokens"), records.backoff(F.lit(2.0), F.col("nth"), 1).alias("wait_s"), gates.stops(F.col("retained"), F.col("artifact")).alias("stop"))


TABLES["reports"] = (
    "nth int; report struct<overall_status:string,summary:string,mutation_score:double>; content string; calls array<string>",
    [(1, {"overall_status": "pass", "summary": "fine", "mutation_score": 0.5}, "text", ["a"]), (2, {"overall_status": "good", "summary": None, "mutation_score": 0.5}, " \n", [" ", "", "b", "c"]), (3, {"overall_status": "fail", "summary": "", "mutation_score": 1.5}, None, None), (4, {"overall_status": "warning", "summary": "s", "mutation_score": None}, "", [])],
)


@_query(["reports"], r"""SELECT nth, CASE WHEN coalesce(report.mutation_score NOT BETWEEN 0 AND 1, true) THEN 'mutation_score' WHEN coalesce(report.overall_status NOT IN ('pass', 'warning', 'fail'), true) THEN 'overall_status' WHEN report.summary IS NULL THEN 'summary' END AS fault,
    CASE WHEN regexp_matches(content, '\S') THEN content ELSE coalesce(list_filter(calls, lambda c: regexp_matches(c, '\S'))[1], '') END AS payload FROM reports""")
def q_first_schema_error(t):
    r = F.col("report")
    rules = {"summary": r["summary"].isNotNull(), "overall_status": r["overall_status"].isin("pass", "warning", "fail"), "mutation_score": r["mutation_score"].between(0, 1)}
    return t("reports").select("nth", records.first_fault(rules).alias("fault"), records.tool_payload(F.col("content"), F.col("calls")).alias("payload"))


TABLES["entries"] = ("nth int; k string; v string", [(1, "b", 'quo"te'), (1, "a", "line\nend"), (1, "ä", None), (2, "z", "\\"), (2, "A", "")])


@_query(["entries"], """SELECT nth, '{' || string_agg(to_json(k) || ': ' || coalesce(to_json(v)::VARCHAR, 'null'), ', ' ORDER BY encode(k)) || '}' AS canonical FROM entries GROUP BY 1""")
def q_canonical_json(t):
    maps = t("entries").groupBy("nth").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    return maps.select("nth", records.canonical_json(F.col("m")).alias("canonical"))


TABLES["grade_files"] = ("value string", [('{"testcases/a": {"grade": "A"}, "set/x/b": {"grade": "d"}, "c": "A", "d": {"grade": 1}, "e": [{"grade": "B"}], "other/a": {"grade": "C"}, "f": {}}',)])


@_query(["grade_files"], "SELECT * FROM (VALUES ('a', 'C'), ('b', 'd')) v(case_id, grade) WHERE (SELECT count(*) FROM grade_files) = 1")
def q_grade_map(t):
    return sources.grades_of(t("grade_files"))


TABLES["results"] = (
    "case_id string; status string; passed boolean; model string; elapsed_s double; generation struct<latency_s:double,prompt_tokens:string,completion_tokens:string>; grader struct<returncode:long,elapsed_s:double>; domain string",
    [("a", "graded", True, "m", 1.5, {"latency_s": 0.5, "prompt_tokens": "10", "completion_tokens": "x"}, {"returncode": 0, "elapsed_s": 0.25}, "rtl"), ("b", "api_error", False, None, 2.0, None, None, None)],
)


@_query(["results"], """SELECT case_id, domain, status, passed, model, elapsed_s, generation.latency_s AS generation_latency_s, try_cast(generation.prompt_tokens AS BIGINT) AS prompt_tokens, try_cast(generation.completion_tokens AS BIGINT) AS completion_tokens,
    grader.returncode AS grader_returncode, grader.elapsed_s AS grader_elapsed_s FROM results""")
def q_summary_rows(t):
    return sources.flat_results(t("results")).select(*sources.SUMMARY_COLUMNS)


TABLES["prose"] = (
    "nth int; body struct<title:string,notes:array<string>,name:string>",
    [(1, {"title": "See CWE-79: unchecked", "notes": ["plain  text ", "sr1, and SR-2 here", None], "name": "cwe_1.md"}), (2, {"title": None, "notes": None, "name": "x"}), (3, {"title": "(e.g., CWE_226 \n uncleared  data)", "notes": [], "name": None})],
)


@_query(["prose"], "SELECT * FROM (VALUES (1, 'See unchecked', 'plain  text |and here', 'cwe_1.md', 'CWE-79'), (2, NULL, NULL, 'x', ''), (3, '(e.g., uncleared data)', '', NULL, 'CWE_226')) v(nth, title, notes, name, removed) WHERE nth IN (SELECT nth FROM prose)")
def q_scrub_nested(t):
    prose = t("prose")
    clean = text.scrubbed_value(F.col("body"), prose.schema["body"].dataType, leave=("name",))
    removed = F.array_join(text.removed_tokens(F.col("body.title")), " ")
    return prose.select("nth", clean.alias("c"), removed.alias("removed")).select("nth", "c.title", F.array_join("c.notes", "|").alias("notes"), "c.name", "removed")


TABLES["readmes"] = (
    "task_id string; readme string; contract array<string>; files array<string>",
    [("contract", "`inputs/a.c`", ["report.json", "key.json"], ["inputs/a.c"]), ("named", "You may only modify `inputs/core.c`. " + "filler " * 40 + "See `inputs/tb.c` too, and `submission/out.json`.", None, ["inputs/core.c", "inputs/tb.c"]),
     ("fallback", "Nothing is said of `inputs/a.c`.", None, ["inputs/z.v", "inputs/sub/b.SV", "inputs/notes.md", "README.md", "inputs/a.c"]), ("none", None, None, ["README.md"])],
)


@_query(["readmes"], "SELECT * FROM (VALUES ('contract', 'submission/report.json submission/key.json'), ('named', 'inputs/core.c'), ('fallback', 'inputs/a.c inputs/sub/b.SV inputs/z.v'), ('none', '')) v(task_id, allowed) WHERE task_id IN (SELECT task_id FROM readmes)")
def q_allowed_paths(t):
    return bundles.allowed_paths(t("readmes")).select("task_id", F.array_join("allowed", " ").alias("allowed"))


TABLES["model_texts"] = (
    "nth int; said string; found string; fixed string",
    [(1, '{"a": 1}', '{"a": 1}', '{"a": 1}'), (2, 'so ```json\n{"a": {"b": 2}}\n``` then {"c": 3}', '{"a": {"b": 2}}', '{"a": {"b": 2}}'), (3, 'x {"s": "}"} y', '{"s": "}"}', None), (4, '{"a": [1, {"b": 2', None, '{"a": [1, {"b": 2}]}'), (5, "[1, 2]", None, None), (6, '{"a": "cut', None, None), (7, '{no} {"k": 5}', '{"k": 5}', None), (8, "", None, None)],
)


@_query(["model_texts"], "SELECT nth, found, fixed FROM model_texts")
def q_model_objects(t):
    return t("model_texts").select("nth", jsonx.embedded_object(F.col("said")).alias("found"), jsonx.repaired_object(F.col("said")).alias("fixed"))


TABLES["netlists"] = ("name string; file string", [("s1", "old"), ("s2", "old"), ("s2", "new"), ("s3", "new")])


@_query(["netlists"], "SELECT name FROM netlists WHERE file = 'new' INTERSECT SELECT name FROM netlists WHERE file = 'old'")
def q_ids_seen_before(t):
    names = t("netlists")
    return graph.first_seen_again(names.where(F.col("file") == "new"), names.where(F.col("file") == "old"), "name")


@_query(["runs"], r"""f AS (SELECT task_id AS g, unnest(list_distinct(regexp_extract_all(stdout, 'FAIL: (\S+)', 1))) AS k FROM runs WHERE arm = 'mutant'), u AS (SELECT DISTINCT task_id AS g, target AS k FROM runs WHERE arm = 'mutant')
    SELECT g, count(*) AS n_true, count(f.k)::BIGINT AS n_both, count(f.k) >= 2 AS reaches FROM u LEFT JOIN (SELECT DISTINCT g, k FROM f) f USING (g, k) GROUP BY 1""")
def q_recall_at_least(t):
    mutants = t("runs").where(F.col("arm") == "mutant")
    truth = mutants.select(F.col("task_id").alias("g"), F.col("target").alias("k"))
    found = mutants.select(F.col("task_id").alias("g"), F.explode(F.regexp_extract_all("stdout", F.lit(r"FAIL: (\S+)"), F.lit(1))).alias("k"))
    scored = coverage.set_scores(truth, found, ["g"], ["k"])
    return coverage.recall_at_least(scored, 2).where(F.col("n_true") > 0).select("g", "n_true", "n_both", "reaches")


TABLES["folders"] = (
    "name string; manifest string; public_spec string; task_spec string; readme string; want string",
    [("a", '{"domain": "nowhere", "spec": {"domain_id": "rtl_trojan_detection"}}', '{"domain_id": "hls_security_codegen"}', None, "", "rtl_trojan_detection"), ("fault_x", "broken", None, '{"metadata": {"task_domain": "gate_trojan_detection"}}', "hls", "gate_trojan_detection"),
     ("B_Side_Channel_HLS", None, "{}", "[]", "recovered_key.json", "hls_security_codegen"), ("case_fault_sat", None, None, None, None, "side_channel_fault_analysis"), ("c", None, None, '{"domain": 3}', "Send Recovered_RTL.v or vulnerability_report.json", "side_channel_fault_analysis"), ("d", None, None, None, "nothing", None)],
)


@_query(["folders"], "SELECT name, want AS domain FROM folders")
def q_inferred_domain(t):
    documents = [F.col(c) for c in ("manifest", "public_spec", "task_spec")]
    return t("folders").select("name", bundles.inferred_domain(documents, F.col("name"), F.col("readme"), [d[0] for d in validation.DOMAINS]).alias("domain"))
