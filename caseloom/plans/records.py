"""Registered queries over records that the fixture tables are written as: documents of JSON, names, reports by line, versions, streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import schemas
from ..operators import graph, ranking, windows
from ..operators import records as record_operators
from ..sources import lines, versions
from ..sources import records as sources
from ..sources.scratch import scratch_folder
from ..streaming import resume, stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str):
    def add(f: Callable[[Callable[[str], DataFrame]], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = run, sql
        return f

    return add


# schemas

EVENT = {
    "type": "object", "additionalProperties": False, "required": ["props", "type", "value"],
    "properties": {
        "props": {"type": "object", "additionalProperties": False, "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 2, "maximum": 90}}},
        "type": {"type": "string", "pattern": "^[a-y]", "enum": ["click", "view", "purchase", "login", "signup"]},
        "value": {"type": "number", "exclusiveMinimum": 1},
    },
}


@_query("""WITH e AS (SELECT event_id, event_type, value, (props->>'$.k')::BIGINT AS k FROM events),
           f AS (SELECT event_id, CASE WHEN k < 2 THEN 'props.k minimum' WHEN k > 90 THEN 'props.k maximum' WHEN NOT regexp_matches(event_type, '^[a-y]') THEN 'type pattern'
                        WHEN event_type NOT IN ('click', 'view', 'purchase', 'login', 'signup') THEN 'type enum' WHEN value <= 1 THEN 'value exclusiveMinimum' END AS e FROM e)
           SELECT event_id, split_part(e, ' ', 1) AS place, split_part(e, ' ', 2) AS rule FROM f WHERE e IS NOT NULL""")
def q_schema_events(t):
    """The first error of each event, written as JSON with its own properties inside."""
    events = t("events").select("event_id", F.to_json(F.struct(F.parse_json("props").alias("props"), F.col("event_type").alias("type"), "value")).alias("text"))
    return events.select("event_id", F.inline(F.array_compact(F.array(schemas.first_error(F.col("text"), EVENT)))))


LINE = {
    "type": "object", "additionalProperties": False, "required": ["flag", "quantity", "returned_on"],
    "properties": {"flag": {"enum": ["N", "A", "R"]}, "quantity": {"type": "number", "maximum": 45}, "returned_on": {"type": "string"}, "discount": {"type": "number", "exclusiveMaximum": 0.1}},
}
BUNDLE = {
    "type": "object", "additionalProperties": False, "required": ["order", "lines"],
    "properties": {"order": {"type": "integer"}, "priority": {"type": "string", "maxLength": 11}, "status": {"type": "string", "enum": ["O", "F"]}, "lines": {"type": "array", "minItems": 2, "maxItems": 6, "items": LINE}},
}


@_query("""WITH l AS (SELECT l_orderkey AS k, l_returnflag AS flag, l_quantity AS q, l_discount AS d, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i FROM lineitem),
           n AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, count(l.k) AS n FROM orders LEFT JOIN l ON l.k = o_orderkey GROUP BY ALL),
           e AS (SELECT k, 0 AS a, 0 AS i, 0 AS b, 'lines' AS place, CASE WHEN n < 2 THEN 'minItems' ELSE 'maxItems' END AS rule FROM n WHERE n < 2 OR n > 6
                 UNION ALL SELECT k, 1, i, 0, 'lines.' || i, 'required' FROM l WHERE flag <> 'R'
                 UNION ALL SELECT k, 1, i, 1, 'lines.' || i || '.discount', 'exclusiveMaximum' FROM l WHERE d >= 0.1
                 UNION ALL SELECT k, 1, i, 2, 'lines.' || i || '.quantity', 'maximum' FROM l WHERE q > 45
                 UNION ALL SELECT k, 2, 0, 0, 'priority', 'maxLength' FROM n WHERE length(p) > 11
                 UNION ALL SELECT k, 3, 0, 0, 'status', 'enum' FROM n WHERE s NOT IN ('O', 'F'))
           SELECT k AS o_orderkey, place, rule FROM e QUALIFY row_number() OVER (PARTITION BY k ORDER BY a, i, b) = 1""")
def q_schema_bundles(t):
    """The first error of each order, written as a JSON document of its lines; lines that were not returned lack a date."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    line = F.struct(F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"), F.when(F.col("l_returnflag") == "R", F.col("l_shipdate").cast("string")).alias("returned_on"), F.col("l_discount").alias("discount"))
    held = t("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))).alias("lines"))  # the lines of one order
    joined = t("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus").join(held, "o_orderkey", "left")
    lines = F.coalesce(F.transform("lines", lambda x: x["line"]), F.array().cast("array<struct<flag: string, quantity: double, returned_on: string, discount: double>>"))
    text = F.to_json(F.struct(F.col("o_orderkey").alias("order"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"), lines.alias("lines")))
    return joined.select("o_orderkey", F.inline(F.array_compact(F.array(schemas.first_error(text, BUNDLE)))))


# names and keys


@_query("""WITH RECURSIVE base AS (SELECT 's' || s_suppkey AS k, 'n' || s_nationkey || CASE WHEN s_suppkey % 7 = 3 THEN '_gen001' WHEN s_suppkey % 11 = 5 THEN '_gen003' ELSE '' END AS base, s_suppkey AS nth FROM supplier),
           taken AS (SELECT DISTINCT 'n' || c_nationkey || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN '_gen002' ELSE '_gen' || lpad((c_custkey % 9 + 1)::VARCHAR, 3, '0') END AS name FROM customer WHERE c_nationkey < 20),
           reserved AS (SELECT name FROM taken UNION SELECT base FROM base),
           free AS (SELECT b.base, i, row_number() OVER (PARTITION BY b.base ORDER BY i) AS k FROM (SELECT DISTINCT base FROM base) b, range(1, 2000) r(i) WHERE b.base || '_gen' || lpad(i::VARCHAR, greatest(3, length(i::VARCHAR))::INTEGER, '0') NOT IN (SELECT name FROM reserved)),
           r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY nth) - CASE WHEN base IN (SELECT name FROM taken) THEN 0 ELSE 1 END AS place FROM base)
           SELECT r.nth AS s_suppkey, r.base, CASE WHEN place = 0 THEN r.base ELSE r.base || '_gen' || lpad(i::VARCHAR, greatest(3, length(i::VARCHAR))::INTEGER, '0') END AS name FROM r LEFT JOIN free f ON f.base = r.base AND f.k = place""")
def q_free_names(t):
    """A free name for every supplier by nation, where some nations' names are numbered names of others and customers hold many."""
    suppliers = t("supplier").select("s_suppkey", F.concat(F.lit("n"), F.col("s_nationkey"), F.when(F.col("s_suppkey") % 7 == 3, "_gen001").when(F.col("s_suppkey") % 11 == 5, "_gen003").otherwise("")).alias("base"))
    number = F.lpad((F.col("c_custkey") % 9 + 1).cast("string"), 3, "0")
    ending = F.when(F.col("c_custkey") % 3 == 0, "").when(F.col("c_custkey") % 3 == 1, "_gen002").otherwise(F.concat(F.lit("_gen"), number))
    taken = t("customer").where(F.col("c_nationkey") < 20).select(F.concat(F.lit("n"), F.col("c_nationkey"), ending).alias("name"))
    return ranking.suffixed(suppliers, "base", ["s_suppkey"], taken)


@_query("""WITH e AS (SELECT doc_id, lang || '_reg [ ' || n_chars % 16 || ' ] & top_' || coalesce(source, 'x') || '[' || doc_id % 16 || '] | ' || lang || '_reg' AS expression FROM documents),
           b AS (SELECT DISTINCT net, bit FROM (SELECT lang || '_reg' AS net FROM documents UNION SELECT source FROM documents), range(8) r(bit) WHERE net IS NOT NULL)
           SELECT doc_id, net, bit::BIGINT AS bit FROM e JOIN b ON regexp_matches(expression, net || '\\s*\\[\\s*' || bit || '\\s*\\]')""")
def q_selected_bits(t):
    """Bits of nets that expressions over documents select, by postings instead of a pattern for every pair."""
    documents = t("documents").select("doc_id", "lang", "source", "n_chars")
    expression = F.concat("lang", F.lit("_reg [ "), F.col("n_chars") % 16, F.lit(" ] & top_"), F.coalesce("source", F.lit("x")), F.lit("["), F.col("doc_id") % 16, F.lit("] | "), "lang", F.lit("_reg"))
    nets = documents.select(F.concat("lang", F.lit("_reg")).alias("net")).union(documents.select("source")).where(F.col("net").isNotNull()).distinct()
    bits = nets.select("net", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("bit"))
    return graph.indexed_nets(documents.select("doc_id", expression.alias("expression")), bits).select("doc_id", "net", "bit")


@_query("""WITH b AS (SELECT l_orderkey AS o, list_sort(list(l_suppkey % 4)) AS key FROM lineitem GROUP BY 1), c AS (SELECT *, o % 10 AS id FROM b WHERE o % 3 <> 0 OR o < 100),
           k AS (SELECT key, min(o) AS o FROM c GROUP BY 1), i AS (SELECT id, min(o) AS o FROM c GROUP BY 1)
           SELECT b.o AS l_orderkey, coalesce(k.o, i.o) AS resolved, k.o IS NOT NULL AS by_key FROM b LEFT JOIN k ON k.key = b.key LEFT JOIN i ON i.id = b.o % 10""")
def q_resolved_baskets(t):
    """For each order the first of the known orders with the same basket, in whatever sequence, else the first with its last digit."""
    baskets = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_suppkey") % 4).alias("key")).withColumn("id", F.col("l_orderkey") % 10)  # the lines of one order
    known = baskets.where((F.col("l_orderkey") % 3 != 0) | (F.col("l_orderkey") < 100))
    return graph.resolved(baskets, known, "id", "key", "l_orderkey").select("l_orderkey", F.col("case.l_orderkey").alias("resolved"), "by_key")


#: Words that stand near the mentions below, and their weights.
NEAR_WORDS = [("the", 1), ("and", 2), ("der", 3), ("que", 4), ("of the", 5)]


@_query("""WITH w(word, weight) AS (VALUES ('the', 1), ('and', 2), ('der', 3), ('que', 4), ('of the', 5)),
           d AS (SELECT doc_id, lower(text) AS low FROM documents WHERE text IS NOT NULL),
           terms AS (SELECT doc_id, low, unnest(['for', 'with', 'des', 'absent']) AS term, true AS mention, 0 AS weight FROM d UNION ALL SELECT doc_id, low, word, false, weight FROM d, w),
           p AS (SELECT doc_id, term, mention, weight, unnest(string_split(low, term)) AS piece, generate_subscripts(string_split(low, term), 1) AS i FROM terms),
           o AS (SELECT doc_id, term, mention, weight, sum(length(piece) + length(term)) OVER (PARTITION BY doc_id, term, mention ORDER BY i) - length(term) AS at, i, max(i) OVER (PARTITION BY doc_id, term, mention) AS n FROM p),
           q AS (SELECT * FROM o WHERE i < n),
           h AS (SELECT DISTINCT m.doc_id, m.term AS mention, m.at, k.term, k.weight FROM q m JOIN q k ON m.mention AND NOT k.mention AND k.doc_id = m.doc_id AND k.at >= m.at - 120 AND k.at + length(k.term) <= m.at + length(m.term) + 120),
           s AS (SELECT doc_id, mention, sum(weight) AS score FROM h GROUP BY ALL)
           SELECT q.doc_id, q.term AS mention, count(*) AS n, coalesce(any_value(score), 0)::BIGINT AS score FROM q LEFT JOIN s ON s.doc_id = q.doc_id AND s.mention = q.term WHERE q.mention GROUP BY ALL""")
def q_keyword_windows(t):
    """Scores of mentions by the words around their places."""
    docs = t("documents").select("doc_id", "text").withColumn("mentions", F.array(*[F.lit(x) for x in ("for", "with", "des", "absent")]))
    return windows.window_scores(docs, "doc_id", "text", "mentions", NEAR_WORDS)


@_query("""SELECT event_id, '{"a":{"k":' || (props->>'$.k') || ',"z":[{"id":' || event_id || ',"n":null}]},"type":"' || event_type || '","user":' || user_id || '}' AS canonical FROM events""")
def q_canonical_json(t):
    """Events written as JSON with keys in no order, nested, as their canonical text."""
    text = F.concat(F.lit('{"user": '), "user_id", F.lit(', "type" : "'), "event_type", F.lit('", "a": {"z": [ {"n": null, "id": '), "event_id", F.lit('} ], "k": '), F.get_json_object("props", "$.k"), F.lit("}}"))
    return t("events").select("event_id", record_operators.canonical_text(text).alias("canonical"))


# sources


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _registered(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


@_registered("""WITH d AS (SELECT doc_id, coalesce(lang, 'none') AS lang, doc_id % 16 AS bucket, string_split('@@doc ' || doc_id || '@@' || chr(10) || coalesce(text, ''), chr(10)) AS ls FROM documents),
           l AS (SELECT doc_id, lang, bucket, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
           n AS (SELECT *, row_number() OVER (PARTITION BY lang, bucket ORDER BY doc_id, i) AS line_no FROM l)
           SELECT doc_id, lang, bucket, min(line_no) AS first_line, count(*) AS n_lines, sum(length(line))::BIGINT AS n_chars, sum(line_no * length(line))::BIGINT AS placed_chars FROM n GROUP BY ALL""")
def q_numbered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as long reports, a heading before each, read back in ranges with line numbers and with the heading carried to its lines."""
    folder = f"{scratch_folder(spark)}/reports"
    body = F.concat(F.lit("@@doc "), F.col("doc_id"), F.lit("@@\n"), F.coalesce("text", F.lit("")))
    docs = _table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("none")).alias("lang"), (F.col("doc_id") % 16).alias("bucket"), "doc_id", body.alias("body"))
    dealt = docs.repartition("lang", "bucket").sortWithinPartitions("lang", "bucket", "doc_id")
    dealt.select("lang", "bucket", "body").write.partitionBy("lang", "bucket").text(folder)
    read = lines.numbered_lines(spark, folder, 1 << 18).withColumn("chars", F.char_length("line"))  # so that no line is shuffled
    carried = lines.carried_lines(read, F.nullif(F.regexp_extract("line", r"^@@doc (\d+)@@$", 1), F.lit("")).cast("long"), "doc_id")
    part = lambda name: F.regexp_extract("file", f"/{name}=([^/]*)/", 1)
    chars = F.col("chars")
    return carried.groupBy("doc_id", part("lang").alias("lang"), part("bucket").cast("long").alias("bucket")).agg(
        F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), F.sum(chars).alias("n_chars"), F.sum(F.col("line_no") * chars).alias("placed_chars")
    )


@_registered("""WITH v AS (SELECT 1 AS version, o_orderkey, o_orderstatus, o_totalprice FROM orders
                 UNION ALL SELECT 2, o_orderkey, CASE o_orderstatus WHEN 'P' THEN 'F' ELSE o_orderstatus END, o_totalprice FROM orders WHERE o_orderpriority <> '5-LOW'
                 UNION ALL SELECT 3, o_orderkey, o_orderstatus, o_totalprice FROM orders)
           SELECT version, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM v GROUP BY ALL""")
def q_published_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders published, published again after a change, and restored; every version as it can be read."""
    orders = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    table = versions.VersionedTable(spark, f"{scratch_folder(spark)}/orders")
    first = table.publish(orders.drop("o_orderpriority"))
    changed = orders.where("o_orderpriority <> '5-LOW'").withColumn("o_orderstatus", F.when(F.col("o_orderstatus") == "P", "F").otherwise(F.col("o_orderstatus")))
    table.publish(changed.drop("o_orderpriority"), expected=first)
    table.restore(first)
    held = [table.read(v).withColumn("version", F.lit(v)) for v in table.versions()]
    return held[0].union(held[1]).union(held[2]).groupBy("version", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@_registered("""SELECT event_id, event_id % 4 = 1 AS in_list, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS event_type, (props->>'$.k')::BIGINT AS k, CASE WHEN event_id % 3 = 0 THEN 'text' ELSE 'number' END AS value_kind
           FROM events WHERE event_id % 4 <> 3""")
def q_drifting_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON lines whose roots are lists, objects or broken, with fields that come, go and change kind; read back by the type that fits all."""
    folder = f"{scratch_folder(spark)}/log"
    e = F.col("event_id")
    value = F.when(e % 3 == 0, F.concat(F.lit('"'), "value", F.lit('"'))).otherwise(F.col("value").cast("string"))
    kind = F.when(e % 5 == 0, "").otherwise(F.concat(F.lit('"type":"'), "event_type", F.lit('",')))
    entry = F.concat(F.lit('{"id":'), e, F.lit(","), kind, F.lit('"value":'), value, F.lit(',"props":'), "props", F.lit("}"))
    line = F.when(e % 4 == 1, F.concat(F.lit("["), entry, F.lit("]"))).when(e % 4 == 3, F.left(entry, F.char_length(entry) - 2)).otherwise(F.concat(F.lit('{"event'), e, F.lit('":'), entry, F.lit("}")))
    _table(spark, sf_dir, "events").select(line.alias("value")).write.text(folder)
    read = sources.settled(sources.root_entries(spark.read.text(folder)))
    text = F.schema_of_variant("read_as.value") == "STRING"
    return read.select("read_as.id", "key", "read_as.type", "read_as.props.k", text.alias("text")).select(
        F.col("id").alias("event_id"), F.col("key").isNull().alias("in_list"), F.col("type").alias("event_type"), "k", F.when(F.col("text"), "text").otherwise("number").alias("value_kind")
    )


# streams

_SPENT = """WITH e AS (SELECT user_id, event_id, event_type, coalesce((props->>'$.k')::BIGINT, 0) AS cost FROM events),
           m AS (SELECT *, coalesce(sum(cost) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before, row_number() OVER w - 1 AS calls_before,
                        coalesce(event_type = lag(event_type) OVER w, false) AS stopped FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
           s AS (SELECT *, coalesce(sum(stopped::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM m)
           SELECT user_id, event_id, spent_before, calls_before, stopped FROM s WHERE earlier = 0 AND spent_before < 300 AND calls_before < 12"""


def _by_arrival(spark: SparkSession, sf_dir: str, n: int) -> tuple[DataFrame, DataFrame]:
    """Events with ``arrival``, an n-th of their ids each, and times that streams can use."""
    events = _table(spark, sf_dir, "events")
    last = events.agg(F.max("event_id").alias("last"))
    return events.join(F.broadcast(last)).withColumn("arrival", F.floor(F.col("event_id") * n / (F.col("last") + 1)).cast("int")).drop("last").withColumn("ts", F.col("ts").cast("timestamp")), events


@_registered(_SPENT)
def q_stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user until a budget, a number of calls or a repeated type ends them: three arrivals, the stream started again for each."""
    work = scratch_folder(spark)
    events, _ = _by_arrival(spark, sf_dir, 3)
    cost = F.get_json_object("props", "$.k").try_cast("long")
    schemas_seen = []

    def start(stream: DataFrame):
        kept = stateful.until_spent(stream, "user_id", ["event_id"], cost, "event_type", 300, 12)
        schemas_seen.append(kept.schema)
        return resume.write_windows(kept, f"{work}/rows", f"{work}/state")

    stateful.in_arrivals(spark, [events.where(F.col("arrival") == k).drop("arrival") for k in range(3)], f"{work}/in", start)
    return resume.read_windows(spark, f"{work}/rows", schemas_seen[0], every=True).select("user_id", "event_id", "spent_before", "calls_before", "stopped")


@_registered("""WITH m AS (SELECT max(event_id) AS last, max(ts) AS final FROM events WHERE NOT (event_id % 13 = 4 AND event_id < (SELECT max(event_id) FROM events) // 3)),
           e AS (SELECT date_trunc('hour', ts) AS hour, event_type FROM events, m WHERE NOT (event_id % 13 = 4 AND event_id < (SELECT max(event_id) FROM events) // 3))
           SELECT hour, event_type, count(*) AS n FROM e, m WHERE hour + INTERVAL 1 HOUR <= date_trunc('milliseconds', final) - INTERVAL 2 HOUR GROUP BY ALL""")
def q_stream_closed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour and type, each window given once, when it is closed; rows that arrive after that are left out. The last arrival is late by most of the month."""
    work = scratch_folder(spark)
    events, plain = _by_arrival(spark, sf_dir, 2)
    bound = plain.agg(F.floor(F.max("event_id") / 3).alias("bound"))
    late = (F.col("event_id") % 13 == 4) & (F.col("event_id") < F.col("bound"))
    marked = events.join(F.broadcast(bound)).withColumn("arrival", F.when(late, 2).otherwise(F.col("arrival"))).drop("bound")
    seen = []

    def start(stream: DataFrame):
        counted = resume.windowed_counts(stream, "ts", "2 hours", "1 hour", ["event_type"])
        seen.append(counted.schema)
        return resume.write_windows(counted, f"{work}/rows", f"{work}/state")

    stateful.in_arrivals(spark, [marked.where(F.col("arrival") == k).drop("arrival") for k in range(3)], f"{work}/in", start)
    rows = resume.read_windows(spark, f"{work}/rows", seen[0], every=True)
    return rows.select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")
