import random
import re
import statistics

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from caseloom.functions import jsonx, scores, text
from caseloom.operators import bundles, coverage, gates, graph, ranking, select, windows
from caseloom.operators import records as record_operators
from caseloom.sources import records
from caseloom.streaming import resume


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()[0]


def test_best_round_tie_rules(spark):
    r = spark.createDataFrame([("a", 1, 5), ("a", 2, 5), ("a", 3, 4)], "id string, round int, score int")
    assert ranking.best_round(r, ["id"], [F.col("score")], "round").first()["round"] == 2
    assert ranking.best_round(r, ["id"], [F.col("score")], "round", later_wins=False).first()["round"] == 1


def test_order_does_not_depend_on_row_order(spark):
    r = spark.range(200).select((F.col("id") % 7).alias("k"), (F.col("id") % 3).alias("v"), "id")
    expected = rows(ranking.majority(r, ["k"], "v", "id"))
    assert rows(ranking.majority(r.orderBy(F.desc("id")).repartition(5), ["k"], "v", "id")) == expected


def test_budget_stops_before_next_call(spark):
    calls = spark.createDataFrame([("c", 1, 60), ("c", 2, 40), ("c", 3, 1)], "id string, seq int, cost int")
    assert [r["seq"] for r in ranking.within_budget(calls, ["id"], ["seq"], F.col("cost"), 100, 80).orderBy("seq").collect()] == [1, 2]


def test_wrong_check_earns_nothing_and_broken_runs_do_not_count(spark):
    runs = [("a", "R1", ["R1", "R5"], False), ("a", "R1", [], False), ("a", "R2", ["R2"], True), ("a", "R3", ["R1"], False), ("a", "R5", ["R1"], False), ("a", "R9", ["R3"], False), ("b", "R1", ["R1", "R1"], True)]
    runs = spark.createDataFrame(runs, "task string, req string, failed array<string>, broke boolean")
    checks = spark.createDataFrame([("a", r) for r in ("R1", "R2", "R3", "R4", "R5")] + [("b", "R1")], "task string, req string")
    states = coverage.discrimination(checks, runs, ["task"], "req")
    got = {(r["task"], r["req"]): (r["targeting"], r["detected"], r["activation"], [s for s in ("dead", "uncovered", "untested") if r[s]]) for r in states.collect()}
    # R5 fires in a run that targets R1: uncovered, but not dead; the run of the unmapped R9 counts for nothing
    assert got == {
        ("a", "R1"): (2, 1, 3, []), ("a", "R2"): (1, 0, 1, ["uncovered"]), ("a", "R3"): (1, 0, 0, ["dead", "uncovered"]), ("a", "R4"): (0, 0, 0, ["untested"]), ("a", "R5"): (1, 0, 1, ["uncovered"]), ("b", "R1"): (1, 0, 1, ["uncovered"]),
    }
    assert coverage.kill_score(runs.where("task = 'a'").withColumn("caught", F.array_contains("failed", F.col("req"))), []).first()["score"] == round(1 / 5, 9)


def test_empty_sets_score_zero_or_one(spark):
    none = spark.createDataFrame([], "g string, k int")
    got = coverage.set_scores(none, spark.createDataFrame([("a", 1)], "g string, k int"), ["g"], ["k"]).first()
    assert (got["precision"], got["recall"], got["f1"], got["recall_or_one"], got["false_share"]) == (0, 0, 0, 1, 1)


def test_markers_leaks_and_scrub(spark):
    out = "[TEST] FAIL: R1\n[TEST]  FAIL: SETUP\n[TEST] FAIL: R1\n[TEST] PASS: R2"
    assert one(spark, text.markers(F.col("t"), text.FAIL_MARKER), t=out) == ["R1"]
    assert one(spark, text.markers(F.col("t"), text.PASS_OR_FAIL_MARKER), t=out) == ["R1", "R2"]
    assert one(spark, text.leaked_tokens(F.col("t")), t="see cwe-79, SR2 and sr1") == ["SR2", "cwe-79"]
    assert one(spark, text.leaked_tokens(F.col("t")), t="CWE_80 cwe81 SR-2") == ["CWE_80", "SR-2", "cwe81"]
    assert one(spark, text.scrubbed(F.col("t")), t="fix SR1,  sr2: the\n bug ") == "fix the bug"
    assert one(spark, text.scrubbed(F.col("t")), t="two  spaces, sr1") == "two  spaces, sr1"
    assert one(spark, text.removed_tokens(F.col("t")), t="SR1 CWE-2 SR1") == ["CWE-2", "SR1", "SR1"]


def test_degenerate_text(spark):
    assert one(spark, text.degenerate(F.col("t")), t="x" * 500)
    assert not one(spark, text.degenerate(F.col("t")), t="x" * 499)
    assert one(spark, text.degenerate(F.col("t")), t="again\n" * 41)


def test_paths(spark):
    assert [one(spark, text.normal_path(F.col("p")), p=p) for p in ("a\\.\\b", "/a", "a/../b", " a//b ", ".")] == ["a/b", None, None, "a/b", None]
    allowed = F.array(F.lit("sub"), F.lit("top.txt"))
    assert [one(spark, text.path_allowed(F.col("p"), allowed), p=p) for p in ("sub/x", "sub", "subx/y", "top.txt")] == [True, True, False, True]


def test_outcomes_and_gate(spark):
    def outcome(status, stdout, stderr=""):
        return one(spark, gates.run_outcome(F.col("s"), F.col("o"), F.col("e")), s=status, o=stdout, e=stderr)

    assert outcome("pass", "") == "undetected"
    assert outcome("fail", "[TEST] FAIL: R1") == "detected"
    assert outcome("fail", "[TEST] FAIL: R1", "Traceback (most recent call last)") == "error"
    assert outcome("fail", "[TEST] FAIL: SETUP") == outcome("timeout", "[TEST] FAIL: R1") == outcome("fail", "") == "error"


def test_statistics_edges(spark):
    one_row = spark.createDataFrame([(1.0, 2.0)], "x double, y double")
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    for df in (one_row, flat):
        assert df.agg(scores.correlation(F.col("x"), F.col("y"))).first()[0] == 0.0
    assert one_row.agg(scores.sample_variance(F.col("x"))).first()[0] == 0.0
    v = spark.createDataFrame([([1, 2, 9],), ([1, 2],)], "v array<int>").select(scores.trimmed(F.col("v")).alias("v"))
    assert [r["v"] for r in v.collect()] == [[2], [1, 2]]


def test_prune_keeps_at_least_one(spark):
    layers = spark.createDataFrame([(i, float(i)) for i in range(4)], "layer int, score double")
    for share, n in ((0.0, 1), (0.5, 2), (1.0, 3)):
        assert select.prune_lowest(layers, "score", "layer", share).where("pruned").count() == n


def test_lenient_json(spark):
    texts = ['{"a": 1}', 'say {"a": "}{"} now', "[1]", 'x {"a": [1, {"b": "c', None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(jsonx.embedded_object(F.col("t")).alias("e"), jsonx.repaired_object(F.col("t")).alias("r")).collect()
    assert [r["e"] for r in got] == ['{"a": 1}', '{"a": "}{"}', None, None, None]
    assert [r["r"] for r in got] == ['{"a": 1}', None, None, None, None]
    assert one(spark, jsonx.repaired_object(F.col("t")), t='{"a": [1, {"b": "c"') == '{"a": [1, {"b": "c"}]}'
    assert one(spark, jsonx.unfenced(F.col("t")), t='```json\n{"a":1}\n```') == '{"a":1}'


def test_closure_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (8, 9)], "src int, dst int")
    got = rows(graph.closure(spark.createDataFrame([(1,)], "start int"), edges))
    assert got == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]


def test_sources(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()
    lines = ['{"seq": 1, "case_id": "a", "passed": true, "generation": {"prompt_tokens": "7"}}', "broken", '{"seq": 2, "case_id": 5}', '{"seq": 3, "case_id": "a", "passed": false}']
    (log / "x.jsonl").write_text("\n".join(lines))
    results = records.read_results(spark, str(log))
    assert sorted((r["seq"], r["case_id"]) for r in results.collect()) == [(1, "a"), (3, "a")]
    assert select.latest(results, ["case_id"], ["seq"]).first()["passed"] is False
    records.write_summary(results, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).columns == records.SUMMARY_COLUMNS
    (tmp_path / "grades.json").write_text('{"x/a": {"grade": "b"},\n "y/c": 3,\n "z/d": {"grade": "A"}}')
    assert rows(records.read_grades(spark, str(tmp_path / "grades.json"))) == [("a", "b"), ("d", "A")]
    for case in ("one", "two"):
        (tmp_path / "cases" / case / "evaluation").mkdir(parents=True)
        (tmp_path / "cases" / case / "README.md").write_text("x")
    (tmp_path / "cases/one/evaluation/evaluate.py").write_text("x")
    assert [r["case"].rsplit("/", 1)[-1] for r in records.discover_cases(spark, str(tmp_path / "cases")).collect()] == ["one"]
    (tmp_path / "trace.csv").write_text("trial_id, secret_operand,cycle_index,mul_en,done\nt1,0x1F,1,1,0\n ,0,1,1,1\n")
    assert rows(records.read_trace(spark, str(tmp_path / "trace.csv"))) == [("t1", 31, 1, 1, 0)]
    samples = spark.createDataFrame([("1,2",), ("1,x",), ("1,2,3",)], "value string")
    assert [r["values"] for r in records.read_samples(samples, 2).collect()] == []
    assert [r["values"] for r in records.read_samples(samples.union(samples), 2).collect()] == [[1, 2]] * 2
    (tmp_path / "none.csv").write_text("trial_id,secret_operand,cycle_index,mul_en,done\n ,0,1,1,1\n")
    with pytest.raises(Exception, match="no data rows"):
        records.read_trace(spark, str(tmp_path / "none.csv")).collect()


def test_stream_keeps_latest(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    schema = "seq long, case_id string, passed boolean"
    for i, batch in enumerate([['{"seq":1,"case_id":"a","passed":false}'], ['{"seq":2,"case_id":"a","passed":true}', '{"seq":3,"case_id":"b","passed":true}']]):
        (source / f"{i}.json").write_text("\n".join(batch))
        query = resume.keep_latest(resume.result_stream(spark, str(source), schema), "case_id", "seq", str(tmp_path / "out"), str(tmp_path / "state"))
        query.awaitTermination(60)
    kept = resume.read_latest(spark, str(tmp_path / "out"), StructType.fromDDL(schema))
    assert rows(kept.select("case_id", "seq")) == [("a", 2), ("b", 3)]


@pytest.mark.parametrize("n", [-1])
def test_negative_sample(spark, n):
    with pytest.raises(ValueError):
        select.seeded_sample(spark.range(3), "id", 1, n)


def test_files_are_written_where_they_belong(spark, tmp_path):
    bundles = spark.createDataFrame([("t1", [("a/run.sh", "echo"), ("../up", "x")]), ("t2", [("b.txt", None)])], "task_id string, files array<struct<path:string,content:string>>")
    got = {(r["task_id"], r["path"], r["written"], r["executable"]) for r in records.write_files(bundles, f"file://{tmp_path}/w").collect()}
    assert got == {("t1", "a/run.sh", True, True), ("t1", "../up", False, False), ("t2", "b.txt", True, False)}
    assert (tmp_path / "w/t1/a/run.sh").read_text() == "echo" and (tmp_path / "w/t2/b.txt").read_text() == "" and not (tmp_path / "w/up").exists()


def test_yaml_rows(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "seeds.yaml").write_text("seeds:\n- seed_id: s1\n  constraints: [a, b]\n- seed_id: s2\n")
    (tmp_path / "none.yaml").write_text("")
    got = records.read_yaml(spark, str(tmp_path), "seed_id string, constraints array<string>").orderBy("seed_id").collect()
    assert [(r["seed_id"], r["constraints"]) for r in got] == [("s1", ["a", "b"]), ("s2", None)]


def test_text_by_ending_or_content(spark):
    files = [("a.SDC", b"\x00"), ("b.bin", b"plain"), ("c.bin", b"x\x00"), ("d/noend", b"\x00"), (".md", b"\x00")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "p string, c binary")
    assert [r[0] for r in df.select(records.is_text(F.col("p"), F.col("c"))).collect()] == [True, True, False, False, False]


def test_names_are_unique_beyond_the_padding(spark):
    named = ranking.suffixed(spark.range(1500).select(F.lit("x").alias("base"), "id"), "base", ["id"])
    assert named.select("name").distinct().count() == 1500


def test_ranks_do_not_need_one_task(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("score"), "id")
    got = {r["id"]: r["rank"] for r in select.ranked(df.repartition(8), ["score", "id"]).collect()}
    assert got == {i: i * 7919 % 1000 + 1 for i in range(1000)}


def test_closure_has_no_depth_limit(spark):
    edges = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).cache()
    start = spark.createDataFrame([(0,)], "start long")
    assert graph.closure(start, edges).agg(F.max("depth")).first()[0] == 60
    assert graph.reaches(start, edges, spark.createDataFrame([(5,)], "node long")).first()["reaches"]
    assert not graph.reaches(start, edges.where("src < 3"), spark.createDataFrame([(5,)], "node long")).first()["reaches"]


def test_names_are_distinct_whatever_is_taken(spark):
    """Against handing out names one by one, with the first row of each base first."""
    r = random.Random(4)
    bases = ["x", "x", "x_gen001", "x_gen003", "x_gen003_gen001", "y_gen02", "y", "x_gen1000"]
    rows = [(i, r.choice(bases)) for i in range(300)] + [(1000 + i, "x") for i in range(1100)] + [(5000, None)]
    taken = ["y", "y_gen002", "x_gen007", "x_gen0008", "x_gen009", "x_gen010", None]
    for given in (None, taken):
        df = spark.createDataFrame(rows, "id int, base string").repartition(5)
        names = None if given is None else spark.createDataFrame([(x,) for x in given * 2], "name string")
        got = {x["id"]: x["name"] for x in ranking.suffixed(df, "base", ["id"], names).collect()}
        used, want, seen = set(given or []) | {b for _, b in rows}, {5000: None}, set()
        for i, b in sorted(rows[:-1]):
            if b not in seen and b not in (given or []):
                want[i] = b
            else:
                n = 1
                while f"{b}_gen{n:03d}" in used:
                    n += 1
                used.add(want.setdefault(i, f"{b}_gen{n:03d}"))
            seen.add(b)
        assert got == want and len(set(got.values())) == len(rows)


def test_correlation_of_large_values(spark):
    df = spark.range(1000).select((F.lit(1e9) + F.col("id")).alias("x"), (F.lit(1e9) + 2 * F.col("id")).alias("y")).union(spark.createDataFrame([(None, 1.0), (5.0, None)], "x double, y double"))
    assert df.agg(scores.correlation(F.col("x"), F.col("y"))).first()[0] == pytest.approx(1.0, abs=1e-9)


def test_order_statistics_of_one_large_group(spark):
    """All rows in one group, and small and empty ones; nothing is gathered in an array."""
    r = random.Random(1)
    groups = {"all": [r.randrange(50) * 1.0 for _ in range(5001)], "one": [3.0], "two": [2.0, 8.0], "three": [5.0, 1.0, 9.0], None: [1.0, 1.0, 4.0, 6.0]}
    data = [(g, v) for g, vs in groups.items() for v in [*vs, None]]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    got = {x["g"]: (x["n"], x["least"], x["median"], x["greatest"]) for x in select.order_statistics(df, ["g"], "v").collect()}
    assert got == {g: (len(v), min(v), statistics.median(v), max(v)) for g, v in groups.items()}
    trimmed = {x["g"]: (x["middle"], x["spread"]) for x in select.trimmed_statistics(df, ["g"], "v").collect()}
    cut = {g: sorted(v)[1:-1] if len(v) > 2 else sorted(v) for g, v in groups.items()}
    assert trimmed == {g: (statistics.median(v), (v[-1] - v[0]) / v[0] if v[0] else None) for g, v in cut.items()}
    plan = select.order_statistics(df, ["g"], "v")._jdf.queryExecution().toString()
    assert "collect_list" not in plan and "percentile" not in plan


def test_recall_ignores_case_where_asked(spark):
    truth, found = (spark.createDataFrame([("a", x) for x in names], "g string, k string") for names in (["KEY_0", "key_1"], ["key_0", "Key_1", "KEY_1"]))
    got = coverage.set_scores(truth, found, ["g"], ["k"], ignore_case=True).first()
    assert (got["n_found"], got["recall_or_one"]) == (2, 1.0) and coverage.set_scores(truth, found, ["g"], ["k"]).first()["n_both"] == 0


def test_bits_are_found_as_a_pattern_would(spark):
    r = random.Random(2)
    nets = ["key_reg", "reg", "g", "data"]
    pieces = ["key_reg", "my_key_reg", "reg", "data", "[", "]", "[ 3 ]", "[3]", "[\t7\n]", "[ 03 ]", " ", "&", "12", "[12]"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randrange(9))) for _ in range(400)]
    bits = spark.createDataFrame([(n, b) for n in nets for b in (0, 3, 7, 12)], "net string, bit long")
    got = {(x["id"], x["net"], x["bit"]) for x in graph.indexed_nets(spark.createDataFrame(list(enumerate(texts)), "id int, expression string"), bits).collect()}
    assert got == {(i, n, b) for i, t in enumerate(texts) for n in nets for b in (0, 3, 7, 12) if re.search(rf"{n}\s*\[\s*{b}\s*\]", t)}


def test_unresolved_entries_are_an_error(spark):
    cases = spark.createDataFrame([(1, [3, 1], 0), (2, [1, 3], 1), (2, [5], 2)], "id int, key array<int>, at int")
    entries = spark.createDataFrame([(9, [1, 3]), (2, [7]), (1, [5])], "id int, key array<int>")
    got = {x["id"]: (x["case"]["at"], x["by_key"]) for x in graph.resolved(entries, cases, "id", "key", "at").collect()}
    assert got == {9: (0, True), 2: (1, False), 1: (2, True)}
    with pytest.raises(Exception, match="no case for 8"):
        graph.resolved(entries.union(spark.createDataFrame([(8, [8])], "id int, key array<int>")), cases, "id", "key", "at").collect()


def test_what_counts_as_missing(spark):
    df = spark.createDataFrame([("", [], None, 0, "x")], "a string, b array<int>, c string, d int, e string").withColumn("m", F.struct(F.lit(None).cast("string").alias("k")))
    first = lambda *c: df.select(record_operators.first_value(*c).alias("v")).first()["v"]
    assert first(F.col("a"), F.col("c"), F.col("e")) == "x" and first(F.col("d"), F.lit(7)) == 7 and first(F.col("a")) is None
    assert first(F.col("m"), F.struct(F.lit("v").alias("k")))["k"] == "v" and first(F.lit(" "), F.lit("y")) == " "


def test_window_scores_equal_a_plain_loop(spark):
    r = random.Random(9)
    vocabulary = ["edit", "modify", "only modify", "inputs/a.c", "inputs/b.v", "Harden", "x", "submission", "lorem ipsum dolor sit amet"]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(120))) for _ in range(60)] + [None, "", "inputs/a.c" * 40]
    paths = ["inputs/a.c", "inputs/b.v", "inputs/none.c"]
    want = {}
    for i, text in enumerate(texts):
        low = (text or "").lower()
        for path in paths:
            places = [m.start() for m in re.finditer(re.escape(path), low)]
            contexts = [low[max(0, at - 120) : at + len(path) + 120] for at in places]
            if places:
                want[i, path] = (len(places), sum(weight for c in contexts for word, weight in bundles.EDIT_WORDS if word in c))
    df = spark.createDataFrame([(i, t, paths) for i, t in enumerate(texts)], "id int, text string, paths array<string>")
    got = {(x["id"], x["mention"]): (x["n"], x["score"]) for x in windows.window_scores(df, "id", "text", "paths").collect()}
    assert got == want
    # the expression for one document gives the same, and 1 more where the file is named
    scored = df.where("text IS NOT NULL").select("id", *[bundles.edit_score(F.col("text"), F.lit(p)).alias(f"s{k}") for k, p in enumerate(paths)]).collect()
    for x in scored:
        for k, path in enumerate(paths):
            assert x[f"s{k}"] == want.get((x["id"], path), (0, 0))[1] + (path.rpartition("/")[2] in (texts[x["id"]] or "").lower())


def test_files_appear_by_one_rename(spark, tmp_path):
    made = lambda bad: spark.createDataFrame([("t", [("a.txt", "one"), ("sub/b.sh", "two")])], "task_id string, files array<struct<path:string,content:string>>").withColumn("task_id", F.when(F.lit(bad), F.raise_error(F.lit("broken"))).otherwise(F.col("task_id")))
    with pytest.raises(Exception, match="broken"):
        records.write_files(made(True), f"file://{tmp_path}/w")
    assert not (tmp_path / "w").exists()
    written = records.write_files(made(False), f"file://{tmp_path}/w")
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "w").rglob("*")}
    assert written.count() == written.count() == 2 and {p: p.stat().st_mtime_ns for p in (tmp_path / "w").rglob("*")} == before
    assert (tmp_path / "w/t/sub/b.sh").read_text() == "two"
    with pytest.raises(FileExistsError):
        records.write_files(made(False), f"file://{tmp_path}/w")


def test_mutation_score_is_meaningful(spark):
    cases = [(False, 0, False, "pass", 0, True), (True, 0, False, "pass", 0, False), (True, 3, False, None, None, True), (True, 3, True, "pass", 0, False), (True, 3, False, "fail", 0, False), (None, None, None, "skipped", 1, False)]
    df = spark.createDataFrame(cases, "w boolean, n int, b boolean, d string, e int, want boolean")
    assert all(x["got"] == x["want"] for x in df.select(gates.mutation_score_meaningful(*[F.col(c) for c in "wnbde"]).alias("got"), "want").collect())


def test_braces_that_nothing_closes():
    assert jsonx.object_in('{"a":' * 200_000) is None and jsonx.object_in("{" * 200_000) is None
    assert jsonx.object_in('{"a":' * 3000 + "1" + "}" * 10 + ' {"b": 1}') is not None
    assert jsonx.repaired("[" * 100_000) is None


def test_closure_walks_an_edge_once_for_many_starts(spark, monkeypatch):
    """Against a search from each start; what a round keeps is a row for 64 starts at a node, not one for each."""
    r, kept, plain = random.Random(3), [], graph.stored

    def counted(df):
        out = plain(df)
        if out.columns == ["block", "node", "mask"]:
            kept.append(out.count())
        return out

    monkeypatch.setattr(graph, "stored", counted)
    pairs = sorted({(r.randrange(150), r.randrange(150)) for _ in range(500)})
    starts = range(100)
    want = set()
    for start in starts:
        depths, front = {start: 0}, [start]
        while front:
            front = list({d for s, d in pairs if s in front and d not in depths})
            depths |= dict.fromkeys(front, max(depths.values()) + 1)
        want |= {(start, n, d) for n, d in depths.items()}
    got = graph.closure(spark.createDataFrame([(s,) for s in starts], "start int"), spark.createDataFrame(pairs, "src int, dst int")).collect()
    assert len(got) == len(want) and {tuple(x) for x in got} == want
    assert sum(kept) < len(want) / 4


def test_budgets_of_groups_cost_few_pandas_calls(spark, monkeypatch, tmp_path):
    """The rows of a user are counted by arrays: a column operation for each rule cost milliseconds a group, whatever its rows."""
    import pandas as pd

    from caseloom.streaming import stateful

    steps = []

    class Stream:
        def __init__(self, df):
            self.df, self.schema = df, df.schema

        def select(self, *columns):
            return Stream(self.df.select(*columns))

        def groupBy(self, _):
            return self

        def applyInPandasWithState(self, step, *_):
            steps.append(step)

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    stream = spark.createDataFrame([(1, 1, "a", 1)], "u long, e long, s string, c long")
    stateful.until_spent(Stream(stream), "u", ["e"], F.col("c"), "s", 300, 12)
    monkeypatch.setattr(pd.Series, "shift", None)
    monkeypatch.setattr(pd.Series, "cumsum", None)
    state = State()
    first = pd.concat(steps[0]((1,), iter([pd.DataFrame({"u": 1, "e": [3, 1], "signature": ["a", "b"], "cost": [100, 250]})]), state))
    assert [tuple(x) for x in first[["e", "spent_before", "calls_before", "stopped"]].to_numpy()] == [(1, 0, 0, False), (3, 250, 1, False)]
    assert state.get == (350, 2, "a", False)
    state = State()
    state.update((10, 1, "a", False))
    parts = [pd.DataFrame({"u": 1, "e": [9], "signature": ["c"], "cost": [1]}), pd.DataFrame({"u": 1, "e": [8], "signature": ["a"], "cost": [5]})]
    then = pd.concat(steps[0]((1,), iter(parts), state))
    assert [tuple(x) for x in then[["e", "spent_before", "calls_before", "stopped"]].to_numpy()] == [(8, 10, 1, True)] and state.get[3]
