"""Registered queries over cases: bundles of files, runs and their markers, traces and result logs, that the fixture tables are read as."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import bundles, coverage, gates, graph, records
from ..sources import records as sources
from ..sources.scratch import scratch_folder
from .records import ORACLE_SQL, QUERIES, _query, _registered, _table  # noqa: F401  queries are added to those of the records


# An order is a case; its lines are its files, its checks, or the cycles of its trace.

_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
_LINES_SQL = "l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS i FROM lineitem)"


def _by_order(t, entry) -> DataFrame:
    """(o, entries): each order's lines as entries, in order."""
    held = F.array_sort(F.collect_list(F.struct(*_LINE_ORDER, entry.alias("entry"))))  # the lines of one order
    return t("lineitem").groupBy(F.col("l_orderkey").alias("o")).agg(F.transform(held, lambda x: x["entry"]).alias("entries"))


@_query(f"""WITH {_LINES_SQL}, m AS (SELECT l_orderkey AS o, i, 'SR-' || l_suppkey % 5 AS name, CASE l_returnflag WHEN 'R' THEN 'FAIL' WHEN 'N' THEN 'PASS' ELSE 'SKIP' END AS kind FROM l),
           d AS (SELECT o, name, kind, min(i) AS i FROM m GROUP BY ALL), e AS (SELECT o, name, min(i) AS i FROM m WHERE kind <> 'SKIP' GROUP BY ALL),
           n AS (SELECT DISTINCT l_orderkey AS o FROM lineitem), a AS (SELECT n.o, 'SR-' || k AS name FROM n, range(5) r(k)),
           g AS (SELECT a.o, string_agg(a.name, ' ' ORDER BY a.name) AS missing FROM a LEFT JOIN e ON e.o = a.o AND e.name = a.name WHERE e.name IS NULL GROUP BY a.o),
           f AS (SELECT o, string_agg(name, ' ' ORDER BY i) FILTER (kind = 'FAIL') AS failed, string_agg(name, ' ' ORDER BY i) FILTER (kind = 'SKIP') AS skipped FROM d GROUP BY o),
           x AS (SELECT o, string_agg(name, ' ' ORDER BY i) AS emitted FROM e GROUP BY o),
           s AS (SELECT o, min(i) FILTER (kind = 'FAIL') AS first FROM m GROUP BY o)
           SELECT n.o AS l_orderkey, coalesce(failed, '') AS failed, coalesce(emitted, '') AS emitted, coalesce(skipped, '') AS skipped, coalesce(missing, '') AS missing,
                  coalesce('[TEST] FAIL: ' || m.name, 'no actionable evaluator output was emitted') AS line, CASE WHEN s.first IS NOT NULL THEN 'detected' ELSE 'error' END AS outcome
           FROM n LEFT JOIN f ON f.o = n.o LEFT JOIN x ON x.o = n.o LEFT JOIN g ON g.o = n.o LEFT JOIN s ON s.o = n.o LEFT JOIN m ON m.o = n.o AND m.i = s.first""")
def q_case_markers(t):
    """What each order's run prints, a marker a line: failed, emitted and skipped checks, those that are missing, the line that explains the run and its outcome."""
    kind = F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_returnflag") == "N", "PASS").otherwise("SKIP")
    runs = _by_order(t, F.concat(F.lit("  [TEST] "), kind, F.lit(": SR-"), F.col("l_suppkey") % 5)).withColumn("stdout", F.array_join("entries", "\n"))
    mapped = F.array(*[F.lit(f"SR-{k}") for k in range(5)])
    found = lambda pattern: text.markers(F.col("stdout"), pattern)
    shown = lambda c: F.array_join(c, " ")
    emitted = found(text.PASS_OR_FAIL_MARKER)
    run = F.struct("stdout", F.lit("").alias("stderr"))
    return runs.select(
        F.col("o").alias("l_orderkey"), shown(found(text.FAIL_MARKER)).alias("failed"), shown(emitted).alias("emitted"), shown(found(text.SKIP_MARKER)).alias("skipped"),
        shown(F.array_except(mapped, emitted)).alias("missing"), text.diagnostic_line(run).alias("line"), gates.run_outcome(F.lit("fail"), F.col("stdout"), F.lit("")).alias("outcome"),
    )


@_query(r"""WITH p AS (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'golden/' WHEN 1 THEN 'inputs/' WHEN 2 THEN 'inputs/mutant_' || page_id % 3 || '/' WHEN 3 THEN 'submission/x/' WHEN 4 THEN 'evaluation/' ELSE 'inputs' END || CASE WHEN page_id % 5 = 0 THEN 'case_manifest.json' ELSE 'f' || page_id % 7 || '.v' END AS path FROM pages)
           SELECT page_id, path, starts_with(path, 'submission/') OR starts_with(path, 'inputs/') OR path = 'inputsf3.v' AS allowed,
                  regexp_matches(path, '^(golden|expert|tests|evaluation|mutants|reports|spec|artifacts)(/|$)|(^|/)(case|run)_manifest\.json$') AS private, NOT regexp_matches(path, '(^|/)(mutant_[^/]*|golden|ground_truth|expert|mutants|reports|artifacts)(/|$)') AS seen FROM p""")
def q_case_paths(t):
    """Which paths an agent may write, which are private and which an evaluator sees."""
    k = F.col("page_id")
    folder = F.when(k % 6 == 0, "golden/").when(k % 6 == 1, "inputs/").when(k % 6 == 2, F.concat(F.lit("inputs/mutant_"), k % 3, F.lit("/"))).when(k % 6 == 3, "submission/x/").when(k % 6 == 4, "evaluation/").otherwise("inputs")
    path = F.concat(folder, F.when(k % 5 == 0, "case_manifest.json").otherwise(F.concat(F.lit("f"), k % 7, F.lit(".v"))))
    pages = t("pages").select("page_id", path.alias("path"))
    allowed = F.array(F.lit("submission/"), F.lit("inputs"), F.lit("inputsf3.v"))
    return pages.select("page_id", "path", text.path_allowed(F.col("path"), allowed).alias("allowed"), sources.is_private(F.col("path")).alias("private"), sources.evaluator_sees(F.col("path")).alias("seen"))


@_query(f"""WITH {_LINES_SQL}, f AS (SELECT l_orderkey AS o, i, CASE WHEN l_returnflag = 'A' THEN '' ELSE 'inputs/' END || 'p' || l_partkey % 4 || '.v' AS path, 'q' || l_quantity::BIGINT AS content, l_linestatus = 'O' AS again FROM l),
           last AS (SELECT o, path, arg_max(content, i) AS content, arg_max(content || '!', i) FILTER (again) AS repaired FROM f GROUP BY ALL),
           m AS (SELECT o, string_agg(path || '=' || coalesce(repaired, content), ';' ORDER BY path) AS overlaid FROM last GROUP BY o),
           p AS (SELECT f.o, string_agg(f.path || '=' || coalesce(last.repaired, f.content), ';' ORDER BY f.i) AS in_place FROM f JOIN last ON last.o = f.o AND last.path = f.path GROUP BY f.o),
           s AS (SELECT o, list(regexp_extract(path, '[^/]*$') ORDER BY i) FILTER (starts_with(path, 'inputs/')) AS shipped FROM f GROUP BY o),
           k AS (SELECT o, string_agg(path, ' ' ORDER BY i) AS kept FROM f WHERE starts_with(path, 'inputs/') OR path = 'p1.v' GROUP BY o)
           SELECT m.o AS l_orderkey, overlaid, in_place, CASE WHEN shipped IS NULL OR list_sort(list_distinct(shipped)) = ['p0.v', 'p1.v'] THEN 'p0.v p1.v' ELSE array_to_string(shipped, ' ') END AS inputs, kept
           FROM m JOIN p ON p.o = m.o JOIN s ON s.o = m.o LEFT JOIN k ON k.o = m.o""")
def q_case_bundles(t):
    """Each order as a bundle of files: repaired ones over it and in their places, inputs as shipped, and what of it is in scope."""
    path = F.concat(F.when(F.col("l_returnflag") == "A", "").otherwise("inputs/"), F.lit("p"), F.col("l_partkey") % 4, F.lit(".v"))
    entry = F.struct(path.alias("path"), F.concat(F.lit("q"), F.col("l_quantity").cast("long")).alias("content"), (F.col("l_linestatus") == "O").alias("again"))
    cases = _by_order(t, entry)
    file = lambda f, mark="": F.struct(f["path"].alias("path"), F.concat(f["content"], F.lit(mark)).alias("content"))
    cases = cases.select("o", F.transform("entries", lambda f: file(f)).alias("files"), F.transform(F.filter("entries", lambda f: f["again"]), lambda f: file(f, "!")).alias("repaired"))
    over = records.file_map(F.col("repaired"))
    merged = F.array_sort(F.map_entries(bundles.overlaid(records.file_map(F.col("files")), over)))
    pairs = lambda entries: F.array_join(F.transform(entries, lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    placed = bundles.replaced_in_place(F.col("files"), over)
    kept = F.transform(records.in_scope(F.col("files"), F.array(F.lit("inputs"), F.lit("p1.v"))), lambda f: f["path"])
    return cases.select(
        F.col("o").alias("l_orderkey"), pairs(merged).alias("overlaid"), F.array_join(F.transform(placed, lambda f: F.concat_ws("=", f["path"], f["content"])), ";").alias("in_place"),
        F.array_join(records.reconciled(F.array(F.lit("p0.v"), F.lit("p1.v")), F.col("files")), " ").alias("inputs"), F.array_join(kept, " ").alias("kept"),
    )


@_query(f"""WITH {_LINES_SQL}, c AS (SELECT l_orderkey AS trial, l_orderkey % 97 AS operand, i, l_returnflag <> 'A' AS on_, l_linestatus = 'O' AS done FROM l),
           f AS (SELECT operand, min(trial) AS trial FROM c GROUP BY 1)
           SELECT c.operand AS secret_operand, count_if(i BETWEEN 1 AND 5 AND on_)::BIGINT AS enable_count, bit_count(c.operand)::INTEGER AS weight, coalesce(array_to_string(list_sort(list(DISTINCT i) FILTER (done)), ' '), '') AS done_cycles,
                  count(DISTINCT i) FILTER (done) = 1 AND bool_or(done AND i = 5) AS steady FROM c JOIN f ON f.operand = c.operand AND f.trial = c.trial GROUP BY c.operand""")
def q_case_traces(t):
    """Orders as traces of cycles: of each operand's first trial, the enabled cycles and those that are done."""
    cycles = _by_order(t, F.struct("l_returnflag", "l_linestatus")).select("o", F.posexplode("entries").alias("at", "e"))
    trace = cycles.select(
        F.col("o").alias("trial_id"), (F.col("o") * 10 + F.col("at")).alias("seq"), (F.col("o") % 97).alias("secret_operand"), (F.col("at") + 1).alias("cycle_index"),
        (F.col("e.l_returnflag") != "A").cast("int").alias("mul_en"), (F.col("e.l_linestatus") == "O").cast("int").alias("done"),
    )
    return records.enable_counts(trace, 5).withColumn("done_cycles", F.array_join(F.col("done_cycles").cast("array<string>"), " "))


@_query("""SELECT o_orderkey, least(9000, 100 * (o_orderkey % 90) + CASE WHEN o_custkey % 2 = 0 THEN o_custkey % 50 * 10 ELSE 0 END) AS once,
                  CASE WHEN o_custkey % 2 = 0 THEN least(9000, 2 * least(9000, 100 * (o_orderkey % 90) + o_custkey % 50 * 10)) ELSE least(9000, 100 * (o_orderkey % 90)) END AS plan_tokens,
                  coalesce(nullif(o_orderkey % 3, 0), nullif(o_custkey % 4, 0), 16000) AS token_limit, 2.0 * power(2, o_orderkey % 5) AS wait,
                  CASE WHEN o_orderkey % 7 = 0 THEN 'retained' WHEN o_orderkey % 5 = 0 THEN 'nothing_to_revise' END AS stop FROM orders""")
def q_case_budgets(t):
    """Token budgets, waits and reasons to stop, a round an order."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    active = c % 2 == 0
    most, base, reasoning = F.lit(9000).cast("long"), 100 * (o % 90), c % 50 * 10
    return t("orders").select(
        "o_orderkey", F.least(most, base + F.when(active, reasoning).otherwise(0)).alias("once"), records.plan_budget(most, base, reasoning, active).alias("plan_tokens"),
        records.token_limit(F.nullif(o % 3, F.lit(0)), F.nullif(c % 4, F.lit(0)), F.lit(None).cast("long")).alias("token_limit"), records.backoff(F.lit(2.0), o % 5).alias("wait"),
        gates.stops(o % 7 == 0, F.when(o % 5 == 0, "none").otherwise("mutants")).alias("stop"),
    )


@_query("""WITH k AS (SELECT l_suppkey AS g, l_partkey % 40 AS k, l_returnflag AS f FROM lineitem), t AS (SELECT DISTINCT g, 'NET_' || k AS k FROM k WHERE f = 'R'), u AS (SELECT DISTINCT g, 'NET_' || k AS k FROM k WHERE f = 'N'),
           a AS (SELECT g FROM t UNION SELECT g FROM u), n AS (SELECT a.g, (SELECT count(*) FROM t WHERE t.g = a.g) AS n_true, (SELECT count(*) FROM t JOIN u ON u.g = t.g AND u.k = t.k WHERE t.g = a.g) AS n_both FROM a)
           SELECT g, n_true, n_both, round(CASE WHEN n_true = 0 THEN 1 ELSE n_both / n_true END, 9) AS recall, n_both >= 3 AS reaches FROM n""")
def q_recall_of_nets(t):
    """Recall of nets that suppliers' lines name in another case, and whether at least three are found."""
    lines = t("lineitem").select(F.col("l_suppkey").alias("g"), F.col("l_partkey") % 40, "l_returnflag").toDF("g", "k", "f")
    named = lambda flag, prefix: lines.where(F.col("f") == flag).select("g", F.concat(F.lit(prefix), "k").alias("k"))
    scored = coverage.recall_at_least(coverage.set_scores(named("R", "NET_"), named("N", "Net_"), ["g"], ["k"], ignore_case=True), 3)
    return scored.select("g", "n_true", "n_both", F.col("recall_or_one").alias("recall"), "reaches")


@_query("""SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag <> 'R')""")
def q_keys_seen_before(t):
    """Parts of returned lines that other lines have too."""
    lines = t("lineitem").select("l_partkey", "l_returnflag")
    return graph.first_seen_again(lines.where("l_returnflag = 'R'").select("l_partkey"), lines.where("l_returnflag <> 'R'").select("l_partkey"), "l_partkey")


@_registered("""SELECT 'case' || event_id AS case_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE 'd' || user_id % 5 END AS domain, event_type AS status, event_id % 3 = 0 AS passed, round(value, 3)::DOUBLE AS elapsed_s,
                  CASE WHEN event_id % 6 <> 1 THEN (props->>'$.k')::BIGINT END AS prompt_tokens, CASE WHEN event_id % 6 <> 1 AND event_id % 10 <> 3 THEN event_id % 100 END AS completion_tokens
           FROM events WHERE event_id % 11 NOT IN (4, 7)""")
def q_summary_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a result log, appended in two goes with broken lines and lines without a name between, read back, flattened and written as a CSV summary; the summary as it is read."""
    work = scratch_folder(spark)
    e = F.col("event_id")
    generation = F.when(e % 6 != 1, F.struct(F.lit(0.5).alias("latency_s"), F.get_json_object("props", "$.k").alias("prompt_tokens"), F.when(e % 10 == 3, "many").otherwise((e % 100).cast("string")).alias("completion_tokens")))
    result = F.to_json(F.struct(
        F.concat(F.lit("case"), e).alias("case_id"), F.when(e % 4 != 0, F.concat(F.lit("d"), F.col("user_id") % 5)).alias("domain"), F.col("event_type").alias("status"), (e % 3 == 0).alias("passed"),
        F.round("value", 3).alias("elapsed_s"), generation.alias("generation"),
    ))
    line = F.when(e % 11 == 4, F.left(result, F.char_length(result) - 3)).when(e % 11 == 7, F.regexp_replace(result, r'"case_id":"case(\d+)"', '"case_id":$1')).otherwise(result)
    events = _table(spark, sf_dir, "events")
    for half in (0, 1):
        events.where(e % 2 == half).select(line.alias("value")).write.mode("append").text(f"{work}/log")
    sources.write_summary(sources.read_results(spark, f"{work}/log"), f"{work}/summary")
    read = spark.read.option("header", True).schema("case_id string, domain string, status string, passed boolean, model string, elapsed_s double, generation_latency_s double, prompt_tokens long, completion_tokens long, grader_returncode long, grader_elapsed_s double").csv(f"{work}/summary")
    return read.select("case_id", "domain", "status", "passed", "elapsed_s", "prompt_tokens", "completion_tokens")
