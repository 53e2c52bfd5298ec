"""Queries over the corpus operators, each over its whole table, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chat_format, decontamination, fill_in_middle, language_id, mixing, near_dedup, quality_rules, sharding, substring_dedup, token_counts, top_k, warc

SHARDS = 40
WEIGHTS = [3.0, 1.0, 2.0]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(_read(spark, sf_dir, "documents"), SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("slot_id").alias("virtual_slot"), F.col("version").alias("map_version"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"), WEIGHTS)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_read(spark, sf_dir, "documents")).drop("text_key")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_read(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.tokens(_read(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "removed_words")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hostile = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(hostile).alias("text"))
    return chat_format.digests(chat_format.format_conversations(turns.union(own)))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contained_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).drop("text_key")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_runs(_read(spark, sf_dir, "documents")).drop("text_key")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.digests(fill_in_middle.transformed(_read(spark, sf_dir, "documents")))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    a_path, b_path = (str(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.aligned(_read(spark, sf_dir, "documents"), a_path, b_path)


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(_read(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sharding, op2_mixing, op3_near_dedup, op4_language_id, op5_warc, op6_token_counts, op7_quality_rules, op8_chat_format, op9_decontamination, op10_substring_dedup, op11_fill_in_middle, op12_token_alignment, op13_exact_top_k)
}

WORD = r"[^\x20\x09-\x0D]+"

#: CRC-32 of a text, by the usual table, built from its rule; {SHARDED} is the source of documents.
_SHARDS_SQL = """
        WITH RECURSIVE tab AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t),
        c AS MATERIALIZED (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
                     xor(4294967295, list_reduce(list_concat([4294967295], list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT)),
                                                 lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) AS text_crc32
              FROM {SHARDED}, tab),
        e AS (SELECT *, row_number() OVER (PARTITION BY doc_id, size, text_crc32) - 1 AS copy FROM c),
        r AS MATERIALIZED (SELECT doc_id, size, text_crc32, (('0x' || substr(sha256(coalesce(doc_id::VARCHAR, 'null') || ':' || text_crc32 || CASE WHEN copy > 0 THEN ':' || copy ELSE '' END), 1, 15))::BIGINT % 4096)::INTEGER AS slot_id FROM e),
        s AS (SELECT slot_id, sum(size)::BIGINT AS b, count(*) AS n FROM r GROUP BY 1),
        o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY b DESC, slot_id) AS nth FROM s),
        p(i, loads, slot_id, shard) AS (
          SELECT 0::BIGINT, list_transform(range(40), lambda x: 0::BIGINT), -1, -1
          UNION ALL SELECT i + 1, list_transform(loads, lambda v, j: CASE WHEN j = pos THEN v + b ELSE v END), slot, (pos - 1)::INTEGER
          FROM (SELECT p.i, p.loads, o.slot_id AS slot, o.b, list_position(p.loads, list_min(p.loads)) AS pos FROM p JOIN o ON o.nth = p.i + 1)),
        m AS (SELECT p.slot_id, p.shard, coalesce(sum(s.n) OVER (PARTITION BY p.shard ORDER BY p.slot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p JOIN s ON s.slot_id = p.slot_id)
        SELECT doc_id, size::BIGINT AS size, text_crc32, {COLUMNS}, m.shard, (m.before + row_number() OVER (PARTITION BY r.slot_id ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot
        FROM r JOIN m ON m.slot_id = r.slot_id"""

ORACLE_SQL: dict[str, str] = {
    "op1_sharding": _SHARDS_SQL.replace("{SHARDED}", "documents").replace("{COLUMNS}", "'bytes' AS law, NULL::INTEGER AS grown_shard, r.slot_id AS virtual_slot, 1 AS map_version"),
    "op2_mixing": rf"""
        WITH d AS (
          SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
                 ('0x' || substr(sha256('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || sha256(coalesce(text, ''))), 1, 15))::BIGINT AS place
          FROM documents),
        s AS (SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth FROM d GROUP BY source),
        w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(nth % 3 + 1)::INT] AS weight, source_size * 2 AS stop FROM s),
        l AS (SELECT *, (sum(source_size) OVER () * 1.5 - coalesce(sum(stop) OVER (ORDER BY stop / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                        / sum(weight) OVER (ORDER BY stop / weight, nth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
        t AS (SELECT source, source_size, least(stop, weight * max(level) OVER ()) AS target FROM l),
        q AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
        r AS (SELECT d.doc_id, d.size, q.source_size::BIGINT AS source_size, q.target, q.whole::BIGINT AS whole,
                     (floor(q.target + 0.5) - q.whole * q.source_size)::BIGINT
                     - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS still
              FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
        SELECT doc_id, size, source_size, target, whole * size + greatest(0, least(size, still)) AS taken FROM r""",
    "op3_near_dedup": rf"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents),
        g AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
                ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS gram FROM w),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM p JOIN n u ON u.doc_id = a JOIN n v ON v.doc_id = b WHERE 100 * shared >= 75 * (u.n + v.n - shared)),
        e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
        c(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, c.root FROM c JOIN e ON e.a = c.doc_id WHERE c.root < e.b)
        SELECT c.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id, c.doc_id = min(root) AS kept
        FROM c LEFT JOIN n ON n.doc_id = c.doc_id GROUP BY c.doc_id""",
    "op5_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
        m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
        SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to
        FROM m""",
    "op7_quality_rules": rf"""
        WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents),
        rawl AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS nth FROM d),
        dup AS (SELECT doc_id, (count(*) - count(DISTINCT raw))::BIGINT AS n FROM rawl WHERE regexp_matches(raw, '{WORD}') GROUP BY doc_id),
        wi AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d),
        tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, ws[i], ws[i + 1], ws[i + 2]) AS n FROM wi),
        cov AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE n > 1) GROUP BY doc_id),
        b AS (SELECT d.doc_id, d.source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
                     length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
              FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id)),
        nl AS (SELECT doc_id, source, nth, trim(regexp_replace(regexp_replace(lower(raw), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM rawl JOIN d USING (doc_id)),
        named AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY nth) AS document FROM nl WHERE line <> '' GROUP BY doc_id),
        li AS (SELECT nl.*, document FROM nl JOIN named USING (doc_id) WHERE line <> ''),
        held AS (SELECT source, line, count(DISTINCT document) AS n FROM li GROUP BY ALL),
        hosts AS (SELECT source, count(DISTINCT document) AS n FROM li GROUP BY ALL),
        found AS (SELECT held.source, line FROM held JOIN hosts ON held.source IS NOT DISTINCT FROM hosts.source WHERE held.n > 20 AND held.n * 100 > hosts.n),
        lost AS (SELECT doc_id, sum(len(regexp_extract_all(li.line, '{WORD}')))::BIGINT AS removed_words
                 FROM li JOIN found ON li.source IS NOT DISTINCT FROM found.source AND li.line = found.line GROUP BY doc_id),
        f AS (SELECT b.*, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(removed_words, 0) AS removed_words FROM b LEFT JOIN lost USING (doc_id))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND removed_words * 100 <= n_words * 50 AS kept, removed_words FROM f""",
    "op8_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
        e AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS nth,
                     length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS text_chars,
                     length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) AS role_chars
              FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
        s AS (SELECT conv_id, count(*)::BIGINT AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY nth) AS said,
                     coalesce(string_agg(text, '' ORDER BY nth) FILTER (WHERE role = 'assistant'), '') AS loss,
                     sum(text_chars + CASE WHEN before IS DISTINCT FROM role THEN role_chars + 8 ELSE 5 END)::BIGINT AS formatted_chars FROM e GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM s""",
    "op9_decontamination": rf"""
        WITH words AS (SELECT 'i' AS kind, item_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM benchmark
                       UNION ALL SELECT 'd', doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') FROM documents),
        i AS (SELECT id, least(5, len(ws)) AS width, unnest(list_distinct(list_transform(range(1, len(ws) - least(5, len(ws)) + 2), lambda k: array_to_string(ws[k:k + least(5, len(ws)) - 1], ' ')))) AS gram FROM words WHERE kind = 'i' AND len(ws) >= 5),
        n AS (SELECT id, count(*) AS n_item FROM i GROUP BY id),
        widths AS (SELECT DISTINCT width FROM i),
        d AS (SELECT id, width, unnest(list_distinct(list_transform(range(1, len(ws) - width + 2), lambda k: array_to_string(ws[k:k + width - 1], ' ')))) AS gram FROM words, widths WHERE kind = 'd' AND len(ws) >= width)
        SELECT d.id AS doc_id, i.id AS item_id, any_value(n_item)::BIGINT AS n_item, count(*)::BIGINT AS n_shared
        FROM d JOIN i ON d.gram = i.gram AND d.width = i.width JOIN n ON n.id = i.id GROUP BY d.id, i.id HAVING 100 * count(*) >= 75 * any_value(n_item)""",
    "op11_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id) AS h FROM documents),
        h AS (SELECT *, len(u) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(h, i, 8))::BIGINT) AS x FROM d),
        c AS (SELECT *, least(x[1] % (n + 1), x[2] % (n + 1)) AS low, greatest(x[1] % (n + 1), x[2] % (n + 1)) AS high,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR x[3] % 100 >= 90 THEN 'plain' WHEN x[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, array_to_string(u[1:low], '') AS pre, array_to_string(u[low + 1:high], '') AS mid, array_to_string(u[high + 1:n], '') AS suf FROM c)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END::BIGINT AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
               sha256(text) AS restored_sha256 FROM p""",
    "op13_exact_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    # every window of 50 words is compared with all others, by its text
    "op10_substring_dedup": r"""
        WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+')) AS piece, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+'), 1) AS nth FROM documents),
        o AS (SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY nth) AS upto FROM p),
        w AS (SELECT doc_id, translate(piece, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS word, upto - length(piece) AS low, upto AS high,
                     row_number() OVER (PARTITION BY doc_id ORDER BY nth) - 1 AS nr FROM o WHERE regexp_matches(piece, '[^\x20\x09-\x0D]')),
        d AS (SELECT doc_id, list(word ORDER BY nr) AS ws FROM w GROUP BY doc_id HAVING count(*) >= 50),
        x AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) AS h, unnest(range(len(ws) - 49)) AS nr FROM d),
        f AS (SELECT *, first_value(doc_id) OVER v AS first_doc_id, first_value(nr) OVER v AS first_at FROM x WINDOW v AS (PARTITION BY h ORDER BY doc_id, nr)),
        r AS (SELECT * FROM f WHERE doc_id <> first_doc_id OR nr - first_at >= 50),
        g AS (SELECT *, coalesce(nr > lag(nr) OVER (PARTITION BY doc_id ORDER BY nr) + 50, true) AS opens FROM r),
        n AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY nr) AS run FROM g),
        s AS (SELECT doc_id, min(nr) AS a, max(nr) + 49 AS b, arg_min(first_doc_id, nr) AS first_doc_id, arg_min(first_at, nr) AS first_at FROM n GROUP BY doc_id, run)
        SELECT s.doc_id, l.low::INTEGER AS start, h.high::INTEGER AS "end", (b - a + 1)::INTEGER AS words, first_doc_id, k.low::INTEGER AS first_start
        FROM s JOIN w l ON l.doc_id = s.doc_id AND l.nr = a JOIN w h ON h.doc_id = s.doc_id AND h.nr = b JOIN w k ON k.doc_id = first_doc_id AND k.nr = first_at""",
}


def pipeline_sql() -> str:
    """The pipeline's rows: every stage's SQL over what the stage before it kept."""
    over = lambda name, table: ORACLE_SQL[name].replace("FROM documents", f"FROM {table}")
    mixed = """SELECT d.* FROM kept3 d JOIN (SELECT doc_id, unnest(range(taken // greatest(size, 1) + CASE WHEN size > 0 AND 2 * (taken % greatest(size, 1)) >= size THEN 1 ELSE 0 END)) FROM ({MIX})) c ON c.doc_id = d.doc_id"""
    sharded = _SHARDS_SQL.replace("{SHARDED}", "mixed4").replace("{COLUMNS}", "r.slot_id AS slot_id, 1 AS version").replace("slot_id AS slot_id", "slot_id")
    return f"""
        WITH kept1 AS MATERIALIZED (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({over("op7_quality_rules", "documents")}) WHERE NOT kept)),
        kept2 AS MATERIALIZED (SELECT * FROM kept1 WHERE doc_id NOT IN (SELECT doc_id FROM ({over("op3_near_dedup", "kept1")}) WHERE NOT kept)),
        kept3 AS MATERIALIZED (SELECT * FROM kept2 WHERE doc_id NOT IN (SELECT doc_id FROM ({over("op9_decontamination", "kept2")}))),
        mixed4 AS MATERIALIZED ({mixed.replace("{MIX}", over("op2_mixing", "kept3"))})
        SELECT * FROM ({sharded})"""
