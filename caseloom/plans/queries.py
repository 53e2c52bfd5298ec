"""Registered queries over the fixture tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import jsonx, scores, text
from ..operators import bundles, coverage, gates, graph, ranking, select
from ..sources.scratch import shared_folder
from ..streaming import resume

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _unknown(c: str):
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("unknown"))


# pass rates, histograms, usage


@_query("""SELECT coalesce(nullif(lang, ''), 'unknown') AS lang, count_if(coalesce(quality = 1, false))::BIGINT AS passed, count(*)::BIGINT AS total,
           count_if(coalesce(quality = 1, false)) / count(*) AS pass_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def q_pass_rate_by_group(t):
    passed = F.count_if(F.coalesce(F.col("quality") == 1, F.lit(False)))
    joined = t("documents").select("doc_id", "lang").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    return joined.groupBy(_unknown("lang").alias("lang")).agg(passed.alias("passed"), F.count("*").alias("total"), (passed / F.count("*")).alias("pass_rate"))


@_query("""SELECT coalesce(lang, 'overall') AS lang, count_if(quality = 1)::BIGINT AS passed, count(*)::BIGINT AS total
           FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang)""")
def q_result_rollup(t):
    joined = t("documents").select("doc_id", "lang").join(t("labels").select("doc_id", "quality"), "doc_id")
    return joined.rollup("lang").agg(F.count_if(F.col("quality") == 1).alias("passed"), F.count("*").alias("total")).na.fill("overall", ["lang"])


@_query("SELECT coalesce(nullif(event_type, ''), 'unknown') AS status, count(*)::BIGINT AS n FROM events GROUP BY 1")
def q_status_histogram(t):
    return t("events").groupBy(_unknown("event_type").alias("status")).agg(F.count("*").alias("n"))


@_query("""WITH e AS (SELECT try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events)
           SELECT sum(k)::BIGINT AS total_tokens, count(k)::BIGINT AS rows_with_usage, count(*)::BIGINT AS n_rows, round(sum(value), 4) AS total_value FROM e""")
def q_usage_totals(t):
    k = F.get_json_object("props", "$.k").try_cast("long")
    return t("events").select(k.alias("k"), "value").agg(F.sum("k").alias("total_tokens"), F.count("k").alias("rows_with_usage"), F.count("*").alias("n_rows"), F.round(F.sum("value"), 4).alias("total_value"))


# selection


@_query("SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_resume_pending(t):
    return select.pending(t("documents").select("doc_id", "lang", "source"), t("labels"), "doc_id")


@_query("""SELECT doc_id, coalesce(CASE quality WHEN 1 THEN 'A' WHEN 0 THEN 'D' END, '') AS grade, coalesce(quality = 1, false) AS usable, quality IS NULL AS ungraded
           FROM documents LEFT JOIN labels USING (doc_id)""")
def q_usable_only(t):
    grades = t("labels").select("doc_id", F.when(F.col("quality") == 1, "a").otherwise("d").alias("grade"))
    return select.graded(t("documents").select("doc_id"), grades, "doc_id", ["A", "B"])


@_query("""SELECT 'found' AS kind, count(*)::BIGINT AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'NONE')
           UNION ALL SELECT 'missing', 3 - count(DISTINCT c_mktsegment) FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY', 'NONE')""")
def q_membership(t):
    customer = t("customer").select("c_mktsegment")
    wanted = customer.sparkSession.createDataFrame([("BUILDING",), ("MACHINERY",), ("NONE",)], "c_mktsegment string")
    found, missing = select.members(customer, wanted, "c_mktsegment")
    return found.agg(F.lit("found").alias("kind"), F.count("*").alias("n")).union(missing.agg(F.lit("missing"), F.count("*")))


@_query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def q_latest_turn(t):
    return select.latest(t("conversations").select("conv_id", "turn", "role", "text"), ["conv_id"], ["turn"])


@_query("SELECT doc_id, sha256('42:' || doc_id) AS sample_order FROM documents ORDER BY sample_order, doc_id LIMIT 25")
def q_seeded_sample(t):
    return select.seeded_sample(t("documents").select("doc_id"), "doc_id", 42, 25)


@_query("""SELECT p_partkey, p_brand, score FROM (SELECT p_partkey, p_brand, p_size::DOUBLE AS score, max(p_size) OVER (PARTITION BY p_brand) AS best FROM part)
           WHERE score >= greatest(5, best - 4)""")
def q_score_rank(t):
    return select.near_best(t("part").select("p_partkey", "p_brand", "p_size"), ["p_brand"], F.col("p_size").cast("double"), 5.0, 4.0).select("p_partkey", "p_brand", "score")


# rounds and sequences

_ROUND_SQL = "SELECT o_custkey, o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_orderkey {}) = 1"


def _best_order(t, later: bool) -> DataFrame:
    orders = t("orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return ranking.best_round(orders, ["o_custkey"], [F.col("o_orderpriority")], "o_orderkey", later)


@_query(_ROUND_SQL.format("DESC"))
def q_keep_best_late_tie(t):
    return _best_order(t, True)


@_query(_ROUND_SQL.format("ASC"))
def q_keep_best_early_tie(t):
    return _best_order(t, False)


@_query("""WITH m AS (SELECT event_id, user_id, ts, event_type, coalesce(event_type = lag(event_type) OVER w AND event_type <> '', false) AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
           s AS (SELECT *, coalesce(sum(r::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM m)
           SELECT event_id, user_id, event_type, r AS stopped FROM s WHERE earlier = 0""")
def q_repeat_stop(t):
    return ranking.until_repeat(t("events").select("event_id", "user_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"], "event_type").drop("ts")


@_query("""WITH s AS (SELECT conv_id, turn, coalesce(sum(length(text)) OVER w, 0)::BIGINT AS spent_before, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS calls_before
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT * FROM s WHERE spent_before < 400 AND calls_before < 5""")
def q_budget_gate(t):
    turns = t("conversations").select("conv_id", "turn", F.length("text").alias("chars"))
    return ranking.within_budget(turns, ["conv_id"], ["turn"], F.col("chars"), 400, 5).drop("chars")


@_query("""SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER w AS running_l_quantity, count(*) OVER w AS running_calls FROM lineitem
           WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS UNBOUNDED PRECEDING)""")
def q_running_usage(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return ranking.running_totals(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], ["l_quantity"]).drop("l_partkey", "l_suppkey", "l_quantity")


@_query("""WITH v AS (SELECT user_id, event_type, count(*) AS votes, min(event_id) AS first_seen FROM events WHERE event_type IS NOT NULL GROUP BY ALL)
           SELECT user_id, event_type, votes FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first_seen) = 1""")
def q_majority(t):
    return ranking.majority(t("events").select("user_id", "event_type", "event_id"), ["user_id"], "event_type", "event_id")


@_query("""SELECT l_orderkey, l_linenumber, bit_count(xor(l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)) & 65535)::INTEGER AS distance FROM lineitem""")
def q_hamming_step(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return ranking.step_distance(lines, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], "l_partkey", 16).drop("l_partkey", "l_suppkey")


@_query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey) = 1")
def q_top_first(t):
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return ranking.best_round(lines, ["l_orderkey"], [F.col("l_extendedprice"), -F.col("l_linenumber")], "l_partkey", later_wins=False)


@_query("SELECT p_brand, p_partkey, p_size FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) = 1")
def q_top_ties(t):
    return ranking.greatest_rows(t("part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size")


@_query("""SELECT s_suppkey, n, CASE WHEN n = 0 THEN base ELSE base || '_gen' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INTEGER, '0') END AS name
           FROM (SELECT s_suppkey, 'nation' || s_nationkey AS base, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS n FROM supplier)""")
def q_suffix_allocation(t):
    named = t("supplier").select("s_suppkey", F.concat(F.lit("nation"), F.col("s_nationkey")).alias("base"))
    out = ranking.suffixed(named, "base", ["s_suppkey"])
    return out.select("s_suppkey", F.coalesce(F.regexp_extract("name", "_gen(\\d+)$", 1).try_cast("long"), F.lit(0)).alias("n"), "name")


@_query("""WITH r AS (SELECT p_brand, p_partkey, p_size > 25 AS preferred, row_number() OVER (PARTITION BY p_brand ORDER BY p_size > 25 DESC, p_partkey) AS nth FROM part),
           s AS (SELECT p_brand, count(*) AS n, count_if(preferred) AS k FROM r GROUP BY 1),
           u AS (SELECT p_brand, n, k, unnest(range(1, greatest(n, 90) + 1)) AS slot FROM s),
           v AS (SELECT p_brand, slot, CASE WHEN slot <= n THEN slot WHEN n > k THEN k + 1 + (slot - n - 1) % (n - k) ELSE 1 + (slot - n - 1) % n END AS nth FROM u)
           SELECT p_brand, slot, p_partkey, preferred FROM v JOIN r USING (p_brand, nth)""")
def q_cyclic_targets(t):
    return ranking.cyclic_targets(t("part").select("p_brand", "p_partkey", "p_size"), "p_brand", F.col("p_size") > 25, "p_partkey", 90).drop("p_size")


# duplicates, coverage, discrimination


@_query("SELECT md5(text) AS text_md5, count(*) AS n FROM documents WHERE coalesce(text, '') <> '' GROUP BY text HAVING count(*) > 1")
def q_dup_text(t):
    keyed = t("documents").where(F.coalesce("text", F.lit("")) != "").select(F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return coverage.repeated(keyed, ["text_md5"])


@_query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q_dup_key(t):
    return coverage.repeated(t("lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@_query("""SELECT p_brand, count(*) AS required, count_if(p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'))::BIGINT AS covered,
           round(count_if(p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')) / count(*), 9) AS coverage FROM part GROUP BY 1""")
def q_map_coverage(t):
    used = t("lineitem").where(F.col("l_returnflag") == "R").select(F.col("l_partkey").alias("p_partkey"))
    return coverage.coverage(t("part").select("p_brand", "p_partkey"), used, ["p_brand"], "p_partkey")


#: A line is a run of its order: its quantity names the check it targets (1 to 50), a returned line fails it, a cheap one fails the check of its line number, and a small open one breaks.
_RUNS_SQL = """SELECT l_orderkey % 97 AS task, l_quantity::INTEGER AS target, list_filter([CASE WHEN l_returnflag = 'R' THEN l_quantity::INTEGER END, CASE WHEN l_discount > 0.05 THEN l_linenumber END], lambda x: x IS NOT NULL) AS failed,
               l_linestatus = 'O' AND l_quantity > 40 AS broke FROM lineitem WHERE l_quantity::INTEGER <> 13"""


def _runs(t) -> DataFrame:
    target = F.col("l_quantity").cast("int")
    failed = F.array_compact(F.array(F.when(F.col("l_returnflag") == "R", target), F.when(F.col("l_discount") > 0.05, F.col("l_linenumber"))))
    lines = t("lineitem").where(target != 13)
    return lines.select((F.col("l_orderkey") % 97).alias("task"), target.alias("target"), failed.alias("failed"), ((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 40)).alias("broke"))


def _checks(t) -> DataFrame:
    return t("lineitem").select((F.col("l_orderkey") % 97).alias("task"), (F.col("l_quantity").cast("int") + F.col("l_linenumber") % 3).alias("target")).distinct()


_STATES_SQL = f"""WITH r AS ({_RUNS_SQL}), c AS (SELECT DISTINCT l_orderkey % 97 AS task, l_quantity::INTEGER + l_linenumber % 3 AS target FROM lineitem),
           o AS (SELECT r.* FROM r SEMI JOIN c ON r.task = c.task AND r.target = c.target),
           a AS (SELECT task, f AS target, count(*) AS activation FROM (SELECT task, unnest(list_distinct(failed)) AS f FROM o) GROUP BY ALL),
           s AS (SELECT task, target, count(*) AS targeting, count_if(NOT broke AND list_contains(failed, target)) AS detected FROM o GROUP BY ALL),
           j AS (SELECT task, target, coalesce(targeting, 0)::BIGINT AS targeting, coalesce(detected, 0)::BIGINT AS detected, coalesce(activation, 0)::BIGINT AS activation FROM c LEFT JOIN s USING (task, target) LEFT JOIN a USING (task, target)),
           d AS (SELECT *, detected > 0 AS covered, targeting > 0 AND activation = 0 AS dead, targeting > 0 AND detected = 0 AS uncovered, targeting = 0 AS untested FROM j)"""


@_query(_STATES_SQL + " SELECT * FROM d")
def q_discrimination(t):
    return coverage.discrimination(_checks(t), _runs(t), ["task"], "target")


@_query(_STATES_SQL + " SELECT task, round(avg(covered::INT), 3) AS discrimination_coverage FROM d GROUP BY 1")
def q_discrimination_coverage(t):
    return coverage.discrimination_coverage(coverage.discrimination(_checks(t), _runs(t), ["task"], "target"), ["task"])


@_query(_STATES_SQL + " SELECT task, target FROM d WHERE uncovered UNION SELECT task, target FROM d WHERE dead UNION SELECT task, target FROM d WHERE untested")
def q_problem_checks(t):
    return coverage.problem_checks(coverage.discrimination(_checks(t), _runs(t), ["task"], "target"), ["task"], "target")


@_query(_STATES_SQL + " SELECT r.task, round(count_if(c.target IS NOT NULL) / count(*), 3) AS static_score FROM r LEFT JOIN c ON r.task = c.task AND r.target = c.target GROUP BY 1")
def q_static_score(t):
    return coverage.static_score(_runs(t).select("task", "target"), _checks(t), ["task"], "target")


@_query(f"""WITH r AS ({_RUNS_SQL}) SELECT task, count_if(NOT broke)::BIGINT AS valid_runs, count_if(NOT broke AND list_contains(failed, target))::BIGINT AS kills, count_if(broke)::BIGINT AS broken,
           round(coalesce(count_if(NOT broke AND list_contains(failed, target)) / nullif(count_if(NOT broke), 0), 0), 9) AS score FROM r GROUP BY 1""")
def q_kill_score(t):
    return coverage.kill_score(_runs(t).withColumn("caught", F.array_contains("failed", F.col("target"))), ["task"])


@_query("""WITH r AS (SELECT p_partkey AS k, CASE WHEN p_size > 25 THEN 'security' ELSE 'functional' END AS kind FROM part WHERE p_retailprice > 950),
           m AS (SELECT l_partkey AS k, CASE WHEN max(l_quantity) > 45 THEN 'security' ELSE 'functional' END AS kind FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
           SELECT coalesce(r.k, m.k) AS k, CASE WHEN r.k IS NULL THEN 'unknown' WHEN m.k IS NULL THEN 'missing' ELSE 'type_mismatch' END AS issue
           FROM r FULL JOIN m ON r.k = m.k WHERE r.kind IS DISTINCT FROM m.kind""")
def q_requirement_compare(t):
    required = t("part").where(F.col("p_retailprice") > 950).select(F.col("p_partkey").alias("k"), F.when(F.col("p_size") > 25, "security").otherwise("functional").alias("kind"))
    mapped = t("lineitem").where(F.col("l_returnflag") == "A").groupBy(F.col("l_partkey").alias("k")).agg(F.when(F.max("l_quantity") > 45, "security").otherwise("functional").alias("kind"))
    return coverage.compare_maps(required, mapped, "k", "kind")


_SETS_SQL = """WITH tr AS (SELECT DISTINCT source, doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1), fo AS (SELECT DISTINCT source, doc_id FROM documents WHERE n_chars > 1500),
           b AS (SELECT coalesce(tr.source, fo.source) AS source, count(tr.doc_id) AS n_true, count(fo.doc_id) AS n_found, count_if(tr.doc_id IS NOT NULL AND fo.doc_id IS NOT NULL) AS n_both
                 FROM tr FULL JOIN fo ON tr.source = fo.source AND tr.doc_id = fo.doc_id GROUP BY 1),
           p AS (SELECT *, coalesce(n_both / nullif(n_found, 0), 0) AS p, coalesce(n_both / nullif(n_true, 0), 0) AS r FROM b)
           SELECT source, n_true, n_found, n_both::BIGINT AS n_both, round(p, 9) AS "precision", round(r, 9) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1,
                  round(coalesce(n_both / nullif(n_true, 0), 1), 9) AS recall_or_one, round(coalesce((n_found - n_both) / nullif(n_found, 0), 0), 9) AS false_share FROM p"""


@_query(_SETS_SQL)
def q_f1_sets(t):
    docs = t("documents").select("doc_id", "source", "n_chars")
    truth = docs.join(t("labels").where(F.col("quality") == 1).select("doc_id"), "doc_id")
    return coverage.set_scores(truth, docs.where(F.col("n_chars") > 1500), ["source"], ["doc_id"])


# set algebra


@_query("""WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 48),
           n AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'N' AND l_discount > 0.09)
           SELECT 'all_three' AS relation, k FROM ((SELECT k FROM a) INTERSECT (SELECT k FROM r) INTERSECT (SELECT k FROM n)) UNION ALL SELECT 'only_first', k FROM ((SELECT k FROM a) EXCEPT (SELECT k FROM r))""")
def q_set_algebra(t):
    lines = t("lineitem")
    flagged = lambda flag, more: lines.where((F.col("l_returnflag") == flag) & more).select(F.col("l_suppkey").alias("k"))
    a, r, n = flagged("A", F.lit(True)), flagged("R", F.col("l_quantity") > 48), flagged("N", F.col("l_discount") > 0.09)
    return graph.all_of([a, r, n], "k").select(F.lit("all_three").alias("relation"), "k").union(a.subtract(r).select(F.lit("only_first"), "k"))


@_query("""WITH o AS (SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag))) AS flags, list_sort(list_distinct(list(l_linestatus))) AS states FROM lineitem GROUP BY 1)
           SELECT l_orderkey, array_to_string(list_filter(['A', 'N', 'R'], lambda x: NOT list_contains(flags, x)), ',') AS missing, list_has_all(['O'], states) AS is_subset, len(flags)::INTEGER AS n_flags FROM o""")
def q_missing_members(t):
    sets = t("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"), F.collect_set("l_linestatus").alias("states"))
    wanted = F.array(F.lit("A"), F.lit("N"), F.lit("R"))
    return sets.select("l_orderkey", F.array_join(F.array_except(wanted, "flags"), ",").alias("missing"), (F.size(F.array_except("states", F.array(F.lit("O")))) == 0).alias("is_subset"), F.size("flags").alias("n_flags"))


# text


@_query(r"""WITH x AS (SELECT doc_id, list_sort(list_distinct(list_concat(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+'), regexp_extract_all(text, 'AKIA[0-9A-Z]{16}')))) AS f FROM documents)
           SELECT doc_id, array_to_string(f[1:8], ' ') AS tokens, least(len(f), 8)::INTEGER AS n FROM x WHERE len(f) > 0""")
def q_leak_tokens(t):
    body = F.col("text")
    # the patterns try every long word, so only texts that can match are searched
    found = text.leaked_tokens(F.when(F.contains(body, F.lit("@")) | F.contains(body, F.lit("AKIA")), body), (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+", r"AKIA[0-9A-Z]{16}"))
    return t("documents").select("doc_id", found.alias("f")).where(F.size("f") > 0).select("doc_id", F.array_join("f", " ").alias("tokens"), F.size("f").alias("n"))


@_query(r"""SELECT doc_id, md5(CASE WHEN regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+')
             THEN regexp_replace(regexp_replace(regexp_replace(text, '(?:[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+)[:,]?[\x20\x09-\x0D]*', '', 'g'), '[\x20\x09-\x0D]{2,}', ' ', 'g'), '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') ELSE text END) AS scrubbed_md5 FROM documents""")
def q_scrub(t):
    body = F.col("text")
    clean = F.when(F.contains(body, F.lit("@")), text.scrubbed(body, (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+",))).otherwise(body)
    return t("documents").select("doc_id", F.md5(clean.cast("binary")).alias("scrubbed_md5"))


_TAIL_LINES_SQL = r"""WITH l AS (SELECT doc_id, unnest(regexp_split_to_array(right(text, 4000), '\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]')) AS line FROM documents), s AS (SELECT doc_id, line FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
           t AS (SELECT doc_id, count(*)::INTEGER AS n_lines, count(DISTINCT line)::INTEGER AS n_distinct, count(*) >= 40 AND count(DISTINCT line) < count(*) * 0.15 AS loops FROM s GROUP BY 1)"""


@_query(_TAIL_LINES_SQL + " SELECT * FROM t")
def q_degenerate(t):
    last = F.right("text", F.lit(4000))
    lines = text.lines_of(last)
    out = t("documents").select("doc_id", lines.alias("lines"), text.few_distinct_lines(last).alias("loops"))
    return out.where(F.size("lines") > 0).select("doc_id", F.size("lines").alias("n_lines"), F.size(F.array_distinct("lines")).alias("n_distinct"), "loops")


# a run is a stretch of places whose character, and whose distance to the place among that character's, stay the same
@_query(_TAIL_LINES_SQL + """, c AS (SELECT doc_id, unnest(string_split(right(text, 4000), '')) AS c, generate_subscripts(string_split(right(text, 4000), ''), 1) AS i FROM documents),
           g AS (SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS run FROM c), x AS (SELECT doc_id FROM g GROUP BY doc_id, c, run HAVING count(*) >= 500)
           SELECT doc_id, coalesce(loops, false) OR doc_id IN (SELECT doc_id FROM x) AS loops FROM documents LEFT JOIN t USING (doc_id)""")
def q_degenerate_runs(t):
    return t("documents").select("doc_id", text.degenerate(F.col("text")).alias("loops"))


@_query(r"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(trim(url)), '[^A-Za-z0-9_-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'page') AS slug, sha256(url) AS url_sha256 FROM pages""")
def q_slug(t):
    return t("pages").select("page_id", text.slug(F.col("url"), "page").alias("slug"), F.sha2("url", 256).alias("url_sha256"))


@_query(r"""WITH p AS (SELECT page_id, '[TEST] FAIL: P' || page_id % 7 || chr(10) || '[TEST] FAIL: A at ' || html AS o, url || ' ' || html AS e FROM pages)
           SELECT page_id, CASE WHEN page_id % 3 > 0 THEN sha256(concat_ws('|', 'multiple', 'fail', page_id, 'A,P' || page_id % 7, 'error', 'None', '', regexp_replace(left(o, 500), '/[^\x20\x09-\x0D:]+', '<path>', 'g'),
                  regexp_replace(right(e, 500), '/[^\x20\x09-\x0D:]+', '<path>', 'g'), regexp_replace(left(e, 500), '/[^\x20\x09-\x0D:]+', '<path>', 'g'))) END AS signature FROM p""")
def q_signature(t):
    out = F.concat(F.lit("[TEST] FAIL: P"), F.col("page_id") % 7, F.lit("\n[TEST] FAIL: A at "), F.col("html"))
    err = F.concat_ws(" ", "url", "html")
    golden = F.struct(F.lit("fail").alias("status"), F.col("page_id").alias("returncode"), out.alias("stdout"), err.alias("stderr"))
    vulnerable = F.struct(F.lit("error").alias("status"), F.lit(None).cast("int").alias("returncode"), err.alias("stdout"), F.lit("").alias("stderr"))
    return t("pages").select("page_id", text.failure_signature(F.when(F.col("page_id") % 3 > 0, "multiple"), golden, vulnerable).alias("signature"))


@_query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<(?:script|style)\b.*?</(?:script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS visible_md5 FROM pages""")
def q_visible_text(t):
    return t("pages").select("page_id", F.md5(text.visible_text(F.col("html")).cast("binary")).alias("visible_md5"))


@_query("""SELECT page_id, CASE WHEN contains(lower(url), '//m.') THEN 'mobile' WHEN contains(lower(url), 'https') THEN 'secure' WHEN contains(lower(url), '?') THEN 'query' ELSE 'other' END AS rule FROM pages""")
def q_rule_chain(t):
    return t("pages").select("page_id", text.first_rule(F.col("url"), [("//m.", "mobile"), ("https", "secure"), ("?", "query")], "other").alias("rule"))


@_query(r"""SELECT page_id, CASE WHEN NOT starts_with(p, '/') AND NOT list_contains(s, '..') AND len(s) > 0 THEN array_to_string(s, '/') END AS path,
              p <> '' AND p <> '.' AND NOT starts_with(p, '/') AND NOT list_contains(string_split(p, '/'), '..') AS safe
           FROM (SELECT page_id, p, list_filter(string_split(p, '/'), lambda x: x <> '' AND x <> '.') AS s FROM (SELECT page_id, regexp_replace(url, '^https?:/', CASE WHEN page_id % 3 = 0 THEN '' ELSE '.' END) AS p FROM pages))""")
def q_safe_paths(t):
    path = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "^https?:/", "")).otherwise(F.regexp_replace("url", "^https?:/", "."))
    return t("pages").select("page_id", path.alias("p")).select("page_id", text.normal_path(F.col("p")).alias("path"), text.safe_path(F.col("p")).alias("safe"))


_GAP = "[^A-Za-z0-9_](?:.{0,38}[^A-Za-z0-9_])?"


@_query(f"""SELECT doc_id, regexp_matches(text, '(?is)(?:^|[^A-Za-z0-9_])(?:the{_GAP}that|that{_GAP}the)(?:[^A-Za-z0-9_]|$)') AS near FROM documents""")
def q_proximity(t):
    return t("documents").select("doc_id", text.near_each_other(F.col("text"), "the", "that", 40).alias("near"))


# every place of a keyword is looked at with the characters around it
@_query("""WITH k AS (SELECT * FROM (VALUES ('reset', 'ation'), ('reset', 'with'), ('scan', 'keit'), ('scan', 'hat'), ('spare', 'mente')) v(category, word)),
           p AS (SELECT doc_id, lower(text) AS low, category, word, string_split(lower(text), word) AS s FROM documents, k WHERE contains(lower(text), word)),
           q AS (SELECT doc_id, category, word, low, unnest(list_transform(range(1, len(s)), lambda i: (list_sum(list_transform(s[1:i], lambda x: length(x))) + (i - 1) * length(word))::BIGINT)) AS pos FROM p),
           h AS (SELECT DISTINCT doc_id, category FROM q WHERE contains(substr(low, greatest(pos - 30, 0) + 1, pos + length(word) + 30 - greatest(pos - 30, 0)), 'that') OR contains(substr(low, greatest(pos - 30, 0) + 1, pos + length(word) + 30 - greatest(pos - 30, 0)), ' und'))
           SELECT doc_id, count(category)::INTEGER AS grounded FROM documents LEFT JOIN h USING (doc_id) GROUP BY 1""")
def q_grounded_categories(t):
    categories = {"reset": ["ation", "with"], "scan": ["keit", "hat"], "spare": ["mente"]}
    return t("documents").select("doc_id", text.grounded_categories(F.col("text"), categories, ["that", " und"], 30).alias("grounded"))


@_query("""SELECT doc_id, md5(array_to_string(s[greatest(len(s) - 2, 1):], chr(10))) AS tail_md5 FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)""")
def q_last_lines(t):
    return t("documents").select("doc_id", F.md5(F.array_join(text.last_lines(F.col("text"), 3), "\n").cast("binary")).alias("tail_md5"))


@_query("""WITH d AS (SELECT DISTINCT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT DISTINCT item_id, unnest(string_split(text, chr(10))) AS line FROM benchmark)
           SELECT doc_id, item_id, count(*) AS shared FROM d JOIN b USING (line) WHERE length(line) > 40 GROUP BY ALL""")
def q_hidden_overlap(t):
    lines = lambda name, key: t(name).select(key, F.explode(F.split("text", "\n")).alias("line")).where(F.length("line") > 40).distinct()
    return lines("documents", "doc_id").join(lines("benchmark", "item_id"), "line").groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


# outcomes and gates

_OUTPUT = "CASE l_returnflag WHEN 'R' THEN '[TEST] FAIL: T' || l_linenumber WHEN 'A' THEN '[TEST] FAIL: SETUP' ELSE '[TEST] PASS: T1' END"
_ERRORS = "CASE l_linenumber WHEN 1 THEN 'Traceback (most recent call last)' WHEN 2 THEN 'Traceback' WHEN 3 THEN '[TEST] FAIL: SETUP' WHEN 4 THEN '[TEST] FAIL: T9' END"


@_query(f"""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linestatus = 'O' AND l_quantity > 30 THEN 'pass' WHEN l_discount > 0.08 THEN 'timeout' ELSE 'fail' END AS status, {_OUTPUT} AS out, {_ERRORS} AS err FROM lineitem)
           SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN status = 'pass' THEN 'undetected' WHEN status = 'timeout' OR contains(out, '[TEST] FAIL: SETUP') OR contains(coalesce(err, ''), 'Traceback (most recent call last)') THEN 'error'
                  WHEN contains(out, '[TEST] FAIL: T') THEN 'detected' ELSE 'error' END AS outcome FROM r""")
def q_outcome_chain(t):
    status = F.when((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 30), "pass").when(F.col("l_discount") > 0.08, "timeout").otherwise("fail")
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", gates.run_outcome(status, F.expr(_OUTPUT), F.expr(_ERRORS)).alias("outcome"))


@_query("""WITH s AS (SELECT source, count(quality) / count(*) AS coverage, coalesce(avg(quality), 0) AS mutation FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1)
           SELECT source, coverage >= 0.4 AS validated, coverage >= 0.8 AND mutation >= 0.5 AS retained FROM s""")
def q_quality_gate(t):
    joined = t("documents").select("doc_id", "source").join(t("labels").select("doc_id", "quality"), "doc_id", "left")
    s = joined.groupBy("source").agg((F.count("quality") / F.count("*")).alias("coverage"), F.coalesce(F.avg("quality"), F.lit(0.0)).alias("mutation"))
    return s.select("source", (F.col("coverage") >= 0.4).alias("validated"), gates.quality_gate(F.lit("pass"), F.lit("warning"), F.col("coverage"), F.col("mutation")).alias("retained"))


@_query("""WITH s AS (SELECT c_custkey, count_if(o_orderstatus = 'O') AS p, count_if(o_orderstatus = 'F') AS f, count_if(o_orderstatus = 'P' AND o_totalprice > 200000) AS q, count_if(o_orderstatus = 'P' AND o_totalprice <= 20000) AS i FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)
           SELECT c_custkey, CASE WHEN i > 0 THEN 'interrupted' WHEN f > 0 AND p > 0 OR q > 0 THEN 'partial' WHEN f > 0 THEN 'failed' ELSE 'complete' END AS state FROM s""")
def q_state_machine(t):
    orders = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus", "o_totalprice")
    status = lambda s, more=True: F.count_if(F.coalesce((F.col("o_orderstatus") == s) & more, F.lit(False)))
    s = t("customer").select("c_custkey").join(orders, "c_custkey", "left").groupBy("c_custkey")
    s = s.agg(status("O").alias("p"), status("F").alias("f"), status("P", F.col("o_totalprice") > 200000).alias("q"), status("P", F.col("o_totalprice") <= 20000).alias("i"))
    return s.select("c_custkey", gates.run_state(F.col("p"), F.col("f"), F.col("q"), F.col("i")).alias("state"))


@_query("""SELECT event_id, CASE WHEN k > 500 AND 1000 - k - 64 >= 64 AND 1000 - k - 64 < 400 THEN 1000 - k - 64 END AS shrunk, least(64 * pow(2, k % 8)::BIGINT, 4096) AS escalated
           FROM (SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events)""")
def q_token_budgets(t):
    k = F.get_json_object("props", "$.k").try_cast("long")
    e = t("events").select("event_id", k.alias("k"))
    shrunk = F.when(F.col("k") > 500, scores.shrunk_budget(F.lit(1000).cast("long"), F.col("k"), F.lit(400).cast("long")))
    return e.select("event_id", shrunk.alias("shrunk"), scores.escalated(F.lit(64).cast("long"), F.col("k") % 8, F.lit(4096).cast("long")).alias("escalated"))


@_query("""SELECT event_id, coalesce(nullif(json_extract_string(props, '$.missing'), ''), json_extract_string(props, '$.k')) AS value FROM events""")
def q_json_ladder(t):
    return t("events").select("event_id", jsonx.first_key(F.col("props"), ["$.missing", "$.k"]).alias("value"))


# what is wrapped is known: the object itself must come back
@_query("SELECT event_id, props AS found, props AS repaired, props AS fenced FROM events")
def q_json_embedded(t):
    wrapped = F.concat(F.lit("Here it is: "), F.col("props"), F.lit(" {not json"))
    fenced = F.concat(F.lit("{no} ```json\n"), F.col("props"), F.lit("\n``` and {\"k\": 0}"))
    return t("events").select("event_id", jsonx.embedded_object(wrapped).alias("found"), jsonx.repaired_object(F.rtrim(F.col("props"), F.lit("}"))).alias("repaired"), jsonx.embedded_object(fenced).alias("fenced"))


@_query("SELECT n_nationkey, 'Hello ' || n_name || ', ' || ' {{ x ' || n_regionkey || '{{n}}' AS rendered FROM nation")
def q_render_template(t):
    values = F.create_map(F.lit("name"), F.col("n_name"), F.lit("n"), F.concat(F.col("n_regionkey"), F.lit("{{n}}")))
    return t("nation").select("n_nationkey", text.rendered(F.lit("Hello {{ name }}, {{missing}} {{ x {{n}}"), values).alias("rendered"))


# statistics


@_query("""SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r FROM lineitem GROUP BY 1""")
def q_corr(t):
    return t("lineitem").groupBy("l_returnflag").agg(F.round(scores.correlation(F.col("l_quantity"), F.col("l_extendedprice")), 6).alias("r"))


@_query("SELECT l_orderkey, round(coalesce(var_samp(l_quantity), 0), 6) AS variance FROM lineitem GROUP BY 1")
def q_var(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.round(scores.sample_variance(F.col("l_quantity")), 6).alias("variance"))


@_query("""WITH m AS (SELECT user_id, event_type, median(value) AS m FROM events GROUP BY ALL) SELECT event_type, round(median(m), 9) AS median_of_medians FROM m GROUP BY 1""")
def q_median2(t):
    inner = select.order_statistics(t("events"), ["user_id", "event_type"], "value").select("event_type", F.col("median").alias("m"))
    return select.order_statistics(inner, ["event_type"], "m").select("event_type", F.round("median", 9).alias("median_of_medians"))


@_query("""WITH v AS (SELECT user_id, list_sort(list(value)) AS v FROM events WHERE value IS NOT NULL GROUP BY 1), x AS (SELECT user_id, CASE WHEN len(v) > 2 THEN v[2:len(v) - 1] ELSE v END AS v FROM v)
           SELECT user_id, round(list_median(v), 9) AS middle, round((v[-1] - v[1]) / nullif(v[1], 0), 6) AS spread FROM x""")
def q_trimmed(t):
    found = select.trimmed_statistics(t("events"), ["user_id"], "value")
    return found.select("user_id", F.round("middle", 9).alias("middle"), F.round("spread", 6).alias("spread"))


@_query("""WITH p AS (SELECT vec_id, label, embedding AS b, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM embeddings),
           c AS (SELECT label, list_cosine_similarity(a::DOUBLE[], b::DOUBLE[]) AS c FROM p WHERE a IS NOT NULL)
           SELECT label, count(*) AS n, round(1 - avg(c), 6) AS influence FROM c GROUP BY 1""")
def q_block_influence(t):
    return _influence(t)


def _influence(t) -> DataFrame:
    before = F.lag("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    pairs = t("embeddings").select("label", F.col("embedding").alias("b"), before.alias("a")).where(F.col("a").isNotNull())
    return pairs.groupBy("label").agg(F.count("*").alias("n"), F.round(1 - F.avg(scores.cosine(F.col("a"), F.col("b"))), 6).alias("influence"))


@_query("""WITH p AS (SELECT vec_id, label, embedding AS b, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS a FROM embeddings),
           c AS (SELECT label, round(1 - avg(list_cosine_similarity(a::DOUBLE[], b::DOUBLE[])), 6) AS influence FROM p WHERE a IS NOT NULL GROUP BY 1),
           k AS (SELECT greatest(1, least(count(*) - 1, round_even(count(*) * 0.25, 0))) AS k FROM c)
           SELECT label, influence, row_number() OVER (ORDER BY influence, label) AS rank, row_number() OVER (ORDER BY influence, label) <= k AS pruned FROM c, k""")
def q_prune_k(t):
    return select.prune_lowest(_influence(t).drop("n"), "influence", "label", 0.25)


@_query("SELECT label, sum(len(list_filter(embedding, lambda x: abs(x::DOUBLE) < 0.05)))::BIGINT AS small, sum(len(embedding))::BIGINT AS total FROM embeddings GROUP BY 1")
def q_sparsity(t):
    small = F.size(F.filter("embedding", lambda x: F.abs(x.cast("double")) < 0.05))
    return t("embeddings").groupBy("label").agg(F.sum(small).alias("small"), F.sum(F.size("embedding")).alias("total"))


@_query("""SELECT l_orderkey, l_linenumber, array_to_string(list_filter(range(0, 16), lambda i: (xor(l_partkey, l_suppkey) >> i) & 1 = 1), ',') AS bits, bit_count(l_partkey & 65535)::INTEGER AS weight FROM lineitem""")
def q_bit_positions(t):
    bits = scores.differing_bits(F.col("l_partkey"), F.col("l_suppkey"))
    return t("lineitem").select("l_orderkey", "l_linenumber", F.array_join(bits.cast("array<string>"), ",").alias("bits"), scores.hamming_weight(F.col("l_partkey")).alias("weight"))


@_query("SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <= 1e-9 THEN abs(l_discount) <= 2 ELSE l_discount BETWEEN l_tax / 2 AND l_tax * 2 END AS in_band FROM lineitem")
def q_ratio_band(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", scores.in_band(F.col("l_discount"), F.col("l_tax"), 2.0).alias("in_band"))


# joins and graphs


@_query("""SELECT o_orderkey, coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NOT NULL THEN 'key' WHEN b.c_custkey IS NOT NULL THEN 'fallback' ELSE 'unresolved' END AS found_by
           FROM orders LEFT JOIN customer a ON a.c_custkey = o_custkey AND a.c_acctbal > 0
           LEFT JOIN (SELECT c_nationkey, min(c_custkey) AS c_custkey FROM customer GROUP BY 1) b ON b.c_nationkey = o_custkey % 25""")
def q_fallback_key(t):
    customer = t("customer").select("c_custkey", "c_nationkey", "c_acctbal")
    by_key = customer.where(F.col("c_acctbal") > 0).select(F.col("c_custkey").alias("o_custkey"), F.col("c_custkey").alias("a"))
    by_nation = customer.groupBy(F.col("c_nationkey").cast("long").alias("nation")).agg(F.min("c_custkey").alias("b"))
    joined = t("orders").select("o_orderkey", "o_custkey").join(by_key, "o_custkey", "left").withColumn("nation", F.col("o_custkey") % 25).join(by_nation, "nation", "left")
    found = F.when(F.col("a").isNotNull(), "key").when(F.col("b").isNotNull(), "fallback").otherwise("unresolved")
    return joined.select("o_orderkey", F.coalesce("a", "b").alias("c_custkey"), found.alias("found_by"))


@_query("SELECT p_partkey, p_brand FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48 AND l_returnflag = 'R')")
def q_dangling(t):
    used = t("lineitem").where((F.col("l_quantity") > 48) & (F.col("l_returnflag") == "R")).select(F.col("l_partkey").alias("p_partkey"))
    return graph.unused(t("part").select("p_partkey", "p_brand"), used, "p_partkey")


@_query("""SELECT a, b, c, count(l_orderkey) AS n FROM (VALUES (false), (true)) x(a), (VALUES (false), (true)) y(b), (VALUES (false), (true)) z(c)
           LEFT JOIN lineitem ON (l_returnflag = 'R') = a AND (l_discount > 0.05) = b AND (l_linestatus = 'O' AND l_returnflag = 'R') = c GROUP BY ALL""")
def q_truth_table(t):
    """Every assignment of three tests, with the lines that have it; some have none."""
    lines = t("lineitem").select((F.col("l_returnflag") == "R").alias("a"), (F.col("l_discount") > 0.05).alias("b"), ((F.col("l_linestatus") == "O") & (F.col("l_returnflag") == "R")).alias("c"))
    seen = lines.groupBy("a", "b", "c").agg(F.count("*").alias("n"))
    return graph.truth_table(lines.sparkSession, ["a", "b", "c"]).join(F.broadcast(seen), ["a", "b", "c"], "left").na.fill(0, ["n"])


#: Parts lead to the part that follows them in an order.
_EDGES_SQL = """e AS (SELECT DISTINCT l_partkey AS src, next AS dst FROM (SELECT l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS next FROM lineitem) WHERE next IS NOT NULL)"""


def _edges(t) -> DataFrame:
    after = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return t("lineitem").select(F.col("l_partkey").alias("src"), after.alias("dst")).where(F.col("dst").isNotNull()).distinct()


def _brand_starts(t) -> DataFrame:
    return t("part").groupBy("p_brand").agg(F.min("p_partkey").alias("start")).select("start")


_CLOSURE_SQL = f"""WITH RECURSIVE {_EDGES_SQL}, s AS (SELECT min(p_partkey) AS start FROM part GROUP BY p_brand),
           r(start, node, depth) AS (SELECT start, start, 0 FROM s UNION SELECT r.start, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.node WHERE r.depth < 20),
           c AS (SELECT start, node, min(depth)::INTEGER AS depth FROM r GROUP BY ALL)"""


@_query(_CLOSURE_SQL + " SELECT * FROM c")
def q_closure(t):
    return graph.closure(_brand_starts(t), _edges(t))


@_query(_CLOSURE_SQL + " SELECT start, node, depth FROM c WHERE depth <= 2")
def q_bounded_cone(t):
    return graph.closure(_brand_starts(t), _edges(t), 2)


@_query(_CLOSURE_SQL + " SELECT start, node, depth FROM c WHERE node <> start")
def q_dependencies(t):
    return graph.dependencies(_brand_starts(t), _edges(t))


@_query(_CLOSURE_SQL + " SELECT start, count_if(p_size > 48) > 0 AS reaches FROM c JOIN part ON p_partkey = node GROUP BY 1")
def q_reachability(t):
    return graph.reaches(_brand_starts(t), _edges(t), t("part").where(F.col("p_size") > 48).select(F.col("p_partkey").alias("node")))


@_query(r"""SELECT page_id, net FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(url, '[A-Za-z_]\w*')) AS net FROM pages) WHERE net IN (SELECT lang FROM documents)""")
def q_net_names(t):
    nets = t("documents").select(F.col("lang").alias("net")).distinct()
    return graph.matching_nets(t("pages").select("page_id", F.col("url").alias("expression")), nets).select("page_id", "net")


@_query("""SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def q_star_join(t):
    lines = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    joined = lines.join(t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(t("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    by_nation = joined.groupBy("c_nationkey").agg(F.count("*").alias("n"), F.sum("v").alias("v"))
    named = by_nation.join(t("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    return named.groupBy("n_name").agg(F.sum("n").alias("n"), F.round(F.sum("v"), 2).alias("revenue"))


@_query("""SELECT time_bucket(INTERVAL 1 day, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def q_event_windows(t):
    w = t("events").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.col("w.start").alias("day"), "event_type", "n", "total")


@_query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || lpad((microsecond(ts) % 1000000)::VARCHAR, 6, '0') END || '+00:00' AS stamp FROM events""")
def q_iso_times(t):
    return t("events").select("event_id", text.iso_time(F.col("ts")).alias("stamp"))


@_query("""SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_concat(list_concat(f, g), h))), ' ') AS ids FROM (SELECT l_orderkey AS o_orderkey, coalesce(list(l_partkey::VARCHAR) FILTER (l_returnflag = 'R'), []) AS f,
           coalesce(list(l_partkey::VARCHAR) FILTER (l_quantity > 45), []) AS g, coalesce(list(l_suppkey::VARCHAR) FILTER (l_discount = 0), []) AS h FROM lineitem GROUP BY 1)""")
def q_set_union(t):
    ids = lambda c, flag: F.collect_set(F.when(flag, F.col(c).cast("string")))
    sets = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(ids("l_partkey", F.col("l_returnflag") == "R").alias("f"), ids("l_partkey", F.col("l_quantity") > 45).alias("g"), ids("l_suppkey", F.col("l_discount") == 0).alias("h"))
    return sets.select("o_orderkey", F.array_join(F.array_sort(F.array_union(F.array_union("f", "g"), "h")), " ").alias("ids"))


@_query("""SELECT l_orderkey, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'R')::BIGINT AS returned, count(DISTINCT l_suppkey) FILTER (l_returnflag = 'R' AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0))::BIGINT AS intersection FROM lineitem GROUP BY 1""")
def q_set_intersection(t):
    trusted = t("supplier").where(F.col("s_acctbal") > 0).select(F.col("s_suppkey").alias("l_suppkey"))
    lines = t("lineitem").select("l_orderkey", "l_suppkey", (F.col("l_returnflag") == "R").alias("back"))
    both = lines.where("back").distinct().join(trusted.withColumn("trusted", F.lit(True)), "l_suppkey", "left")
    counted = both.groupBy("l_orderkey").agg(F.count("*").alias("returned"), F.count("trusted").alias("intersection"))
    return lines.select("l_orderkey").distinct().join(counted, "l_orderkey", "left").na.fill(0, ["returned", "intersection"])


# bundles, summaries and streams


@_query("""WITH f AS (SELECT l_orderkey, list('submission/' || l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) AS paths, bool_or(l_discount = 0) AS empty FROM lineitem GROUP BY 1)
           SELECT l_orderkey, CASE WHEN empty THEN 'bad_content' WHEN len(list_distinct(paths)) < len(paths) THEN 'duplicate_path' WHEN NOT list_has_all(paths, ['submission/A', 'submission/N', 'submission/R']) THEN 'missing_path' END AS fault FROM f""")
def q_bundle_faults(t):
    file = F.struct(F.concat(F.lit("submission/"), F.col("l_returnflag")).alias("path"), F.when(F.col("l_discount") != 0, F.col("l_linestatus")).alias("content"))
    bundles_ = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(file).alias("files"))
    allowed = F.array(*[F.lit(f"submission/{x}") for x in "ANR"])
    return bundles_.select("l_orderkey", bundles.bundle_fault(F.col("files"), allowed).alias("fault"))


@_query("""SELECT c_custkey, len(list_filter([0, 1, 2, 9, 40], lambda i: i < length(c_name) AND i < length(c_mktsegment) AND substr(upper(c_name), i + 1, 1) = substr(c_mktsegment, i + 1, 1))) / 5 AS matched FROM customer""")
def q_position_match(t):
    positions = F.array(*[F.lit(i) for i in (0, 1, 2, 9, 40)])
    return t("customer").select("c_custkey", bundles.position_match(F.upper("c_name"), F.col("c_mktsegment"), positions).alias("matched"))


@_query("""SELECT user_id, sum(k)::BIGINT AS completion, sum(CASE WHEN event_type = 'click' THEN k ELSE 0 END)::BIGINT AS reasoning, sum(CASE WHEN event_type = 'click' THEN k ELSE 0 END) > 0.25 * sum(k) AS high_share
           FROM (SELECT user_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1""")
def q_reasoning_share(t):
    e = t("events").select("user_id", "event_type", F.coalesce(F.get_json_object("props", "$.k").try_cast("long"), F.lit(0)).alias("k"))
    sums = e.groupBy("user_id").agg(F.sum("k").alias("completion"), F.sum(F.when(F.col("event_type") == "click", F.col("k")).otherwise(0)).alias("reasoning"))
    return sums.withColumn("high_share", F.col("reasoning") > F.col("completion") * 0.25)


@_query("""SELECT o_orderkey, o_totalprice AS reported, coalesce(round(sum(l_extendedprice), 2), 0) AS computed, abs(o_totalprice - coalesce(sum(l_extendedprice), 0)) > 0.01 AS overridden
           FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def q_recomputed_summary(t):
    sums = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("s"))
    joined = t("orders").select("o_orderkey", "o_totalprice").join(sums, "o_orderkey", "left")
    won = gates.computed_wins(F.col("o_totalprice"), F.coalesce("s", F.lit(0.0)))
    return joined.select("o_orderkey", F.col("o_totalprice").alias("reported"), F.round(won["value"], 2).alias("computed"), won["overridden"].alias("overridden"))


@_query("""WITH best AS (SELECT l_partkey, l_suppkey, max(l_quantity) AS q FROM lineitem GROUP BY ALL)
           SELECT l_partkey, l_suppkey, CASE WHEN q >= 45 THEN 'kept' ELSE 'regenerate' END AS part FROM best""")
def q_keep_or_regenerate(t):
    best = t("lineitem").groupBy("l_partkey", "l_suppkey").agg(F.max("l_quantity").alias("q"))
    return best.select("l_partkey", "l_suppkey", F.when(F.col("q") >= 45, "kept").otherwise("regenerate").alias("part"))


@_query("""SELECT s_nationkey, count(*) AS n, count(*) = max(count(*)) OVER () AND count(*) = min(count(*)) OVER () AS balanced FROM supplier GROUP BY 1""")
def q_domain_balance(t):
    n = t("supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"))
    ends = n.agg(F.max("n").alias("most"), F.min("n").alias("least"))
    return n.join(F.broadcast(ends)).select("s_nationkey", "n", (F.col("most") == F.col("least")).alias("balanced"))


def q_stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user, kept by a file stream that runs until its input is read."""
    work = f"{shared_folder(spark)}/caseloom-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern may also match a single file
    query = resume.keep_latest(stream, "user_id", "event_id", f"{work}/latest", f"{work}/state")
    query.awaitTermination()
    return resume.read_latest(spark, f"{work}/latest", schema).select("user_id", "event_id", "event_type")


def _streamed(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """The rows that a stream over all events leaves in a table."""
    work = f"{shared_folder(spark)}/caseloom-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = build(spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp")))
    query = resume.write_windows(stream, f"{work}/rows", f"{work}/state", mode)
    query.awaitTermination()
    return resume.read_windows(spark, f"{work}/rows", stream.schema)


def q_stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type, counted by a stream with a bound on late events."""
    rows = _streamed(spark, sf_dir, lambda s: resume.windowed_counts(s, "ts", "1 hour", "1 hour", ["event_type"]), "complete")
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")


def q_stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a user's events without a gap of six hours, found by a stream."""
    rows = _streamed(spark, sf_dir, lambda s: resume.sessions(s, "ts", "1 hour", "6 hours", "user_id"), "complete")
    return rows.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("starts"), F.col("session.end").cast("timestamp_ntz").alias("ends"), "n")


QUERIES["q_stream_windows"] = q_stream_windows
ORACLE_SQL["q_stream_windows"] = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL"
QUERIES["q_stream_sessions"] = q_stream_sessions
ORACLE_SQL["q_stream_sessions"] = """WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM g)
    SELECT user_id, min(ts) AS starts, max(ts) + INTERVAL 6 HOUR AS ends, count(*) AS n FROM n GROUP BY user_id, nth"""
QUERIES["q_stream_latest"] = q_stream_latest
ORACLE_SQL["q_stream_latest"] = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"
