"""Sharding by fixed virtual slots.

Every record hashes into one of a fixed, large number of slots. Bytes are summed
per slot (a table of at most ``n_slots`` rows whatever the corpus holds), and a
slot-to-shard map is derived from those sums: the heaviest slot first, each to the
shard that is lightest so far. The map is stored with its version, and records are
placed by what is stored. Rebalancing edits the map into its next version, never
the hash, so only records of the slots that the edit names move.

Records equal in key, size and checksum of the text are counted before anything
else and then dealt copy by copy: a slot is hashed from key, checksum and the number
of the copy. So a null or repeated key, a repeated text, and a row that is a third of
all rows each spread over the slots, and no slot's rows are more than its share.
Equal records are interchangeable, so their numbers need no order; the copies of a
record that has very many are made by many tasks.

Nulls and odd input: a null text has no bytes, a null key column hashes like any
other value, an empty table gives an empty assignment, and repeated rows each get
a position of their own; a very long text weighs its bytes, and its slot goes to a
shard that is light. Extra columns of the input are neither read nor changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import scratch_path, stash

DEFAULT_SLOTS = 4096
#: Bytes that a record takes besides its text.
RECORD_OVERHEAD = 16
#: Copies of one record that a task makes at once.
COPIES = 4096

_MAP_SCHEMA = "slot_id int, slot_bytes long, slot_rows long, shard int, version int"


def record_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(RECORD_OVERHEAD)).cast("long")


def slot_of(keys: list[Column], n_slots: int = DEFAULT_SLOTS) -> Column:
    """The slot that a record's keys hash into: 60 bits of a digest that any other system can compute too."""
    text = F.concat_ws(":", *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long"), F.lit(n_slots)).cast("int")


def slot_totals(records: DataFrame) -> DataFrame:
    """Bytes and rows per slot of ``records`` (slot_id, size)."""
    return records.groupBy("slot_id").agg(F.sum("size").alias("slot_bytes"), F.count("*").alias("slot_rows"))


def _lightest(loads: Column) -> Column:
    return F.array_position(loads, F.array_min(loads)).cast("int") - 1


def _loaded(loads: Column, shard: Column, by: Column) -> Column:
    return F.transform(loads, lambda load, i: F.when(i == shard, load + by).otherwise(load))


def build_map(totals: DataFrame, n_shards: int, version: int = 1) -> DataFrame:
    """A first map: slots by falling bytes, each to the lightest shard.

    The slots fit one array (their number is fixed), so one fold over that array
    decides all of them.
    """
    slots = F.array_sort(F.collect_list(F.struct((-F.col("slot_bytes")).alias("order"), "slot_id", "slot_bytes", "slot_rows")))
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), n_shards).alias("loads"),
        F.lit(None).cast("array<struct<slot_id:int,slot_bytes:bigint,slot_rows:bigint,shard:int>>").alias("placed"),
    )

    def place(state: Column, slot: Column) -> Column:
        to = _lightest(state["loads"])
        row = F.struct(slot["slot_id"].alias("slot_id"), slot["slot_bytes"].alias("slot_bytes"), slot["slot_rows"].alias("slot_rows"), to.alias("shard"))
        return F.struct(_loaded(state["loads"], to, slot["slot_bytes"]).alias("loads"), F.concat(F.coalesce(state["placed"], F.array().cast("array<struct<slot_id:int,slot_bytes:bigint,slot_rows:bigint,shard:int>>")), F.array(row)).alias("placed"))

    placed = totals.agg(slots.alias("slots")).select(F.explode(F.aggregate("slots", start, place)["placed"]).alias("s"))
    return placed.select("s.slot_id", "s.slot_bytes", "s.slot_rows", "s.shard", F.lit(version).alias("version"))


def add_shard(slot_map: DataFrame) -> DataFrame:
    """The map's next version with one more shard.

    The new shard takes slots, heaviest first, from shards that stay at or above
    the new mean without them, until it reaches that mean; every other slot
    stays where it is.
    """
    slots = F.array_sort(F.collect_list(F.struct((-F.col("slot_bytes")).alias("order"), "slot_id", "slot_bytes", "slot_rows", "shard", "version")))
    whole = slot_map.agg(slots.alias("slots"), F.max("shard").alias("last"), F.sum("slot_bytes").alias("total"))
    whole = whole.withColumn("mean", F.col("total") / (F.col("last") + 2)).withColumn(
        "loads", F.expr("transform(sequence(0, last + 1), k -> aggregate(filter(slots, s -> s.shard = k), 0L, (t, s) -> t + s.slot_bytes))")
    )
    moved = F.expr(
        """aggregate(slots, named_struct('loads', loads, 'taken', cast(array() as array<int>)), (a, s) ->
             if(a.loads[s.shard] - s.slot_bytes >= mean and a.loads[last + 1] + s.slot_bytes <= mean,
                named_struct('loads', transform(a.loads, (v, k) -> if(k = s.shard, v - s.slot_bytes, if(k = last + 1, v + s.slot_bytes, v))),
                             'taken', concat(a.taken, array(s.slot_id))), a)).taken"""
    )
    edited = whole.withColumn("taken", moved).select(F.explode("slots").alias("s"), "taken", "last")
    shard = F.when(F.array_contains("taken", F.col("s.slot_id")), F.col("last") + 1).otherwise(F.col("s.shard"))
    return edited.select("s.slot_id", "s.slot_bytes", "s.slot_rows", shard.cast("int").alias("shard"), (F.col("s.version") + 1).cast("int").alias("version"))


def save_map(slot_map: DataFrame, path: str) -> None:
    """Store a map's versions; versions already there stay, but for those it holds itself, so a repeated save changes nothing."""
    slot_map.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A stored version, the newest by default."""
    stored = spark.read.schema(_MAP_SCHEMA).parquet(path)
    if version is None:
        version = stored.agg(F.max("version")).first()[0]
    return stored.where(F.col("version") == F.lit(version))


def assign(records: DataFrame, slot_map: DataFrame, order: list[str]) -> DataFrame:
    """``records`` with ``shard`` and ``slot``, the record's gapless position in its shard.

    Positions are counted inside each virtual slot and moved on by the rows of the
    shard's earlier slots, so no task sorts a whole shard. The map is broadcast:
    it has one narrow row per slot, a number fixed beforehand.
    """
    before = Window.partitionBy("shard").orderBy("slot_id").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slot_map.select("slot_id", "shard", "version", F.coalesce(F.sum("slot_rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("slot_id").orderBy(*order)
    placed = records.withColumn("nth", F.row_number().over(inside)).join(F.broadcast(offsets), "slot_id")
    return placed.withColumn("slot", (F.col("offset") + F.col("nth") - 1).cast("long")).drop("offset", "nth")


def document_records(docs: DataFrame, n_slots: int = DEFAULT_SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, slot_id) of documents, one row for each of theirs.

    Texts stay where they are: only narrow rows are counted and dealt.
    """
    text = F.col(text_col)
    narrow = docs.select(F.col(id_col).alias("id"), record_bytes(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    value = ["id", "size", "text_crc32"]
    counted = stash(narrow.groupBy(*value).agg(F.count("*").alias("copies")), "values")
    numbers = lambda low, high: F.explode(F.sequence(low, high)).alias("copy")
    few = counted.where(F.col("copies") <= COPIES).select(*value, numbers(F.lit(0).cast("long"), F.col("copies") - 1))
    stretches = counted.where(F.col("copies") > COPIES).select(*value, "copies", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")).alias("stretch"))
    first = F.col("stretch") * COPIES
    many = stretches.repartition(*value, "stretch").select(*value, numbers(first, F.least(first + COPIES, F.col("copies")) - 1))
    keys = [F.col("id"), F.col("text_crc32")]
    slot = F.when(F.col("copy") == 0, slot_of(keys, n_slots)).otherwise(slot_of([*keys, F.col("copy")], n_slots))
    return few.union(many).select(F.col("id").alias(id_col), "size", "text_crc32", slot.alias("slot_id"))


def shard_documents(docs: DataFrame, n_shards: int, n_slots: int = DEFAULT_SLOTS, id_col: str = "doc_id", text_col: str = "text", map_path: str | None = None, version: int | None = None) -> DataFrame:
    """Spread documents over shards of near equal bytes, by a stored map.

    Returns id, size, text_crc32, slot_id, shard, version and slot (the position
    in the shard). The first version of the map is made from these documents and
    stored at ``map_path`` (in the shared folder, if none is given); where
    ``version`` is given, that version is read from there instead, and its sums
    must be those of the same documents.
    """
    spark = docs.sparkSession
    records = stash(document_records(docs, n_slots, id_col, text_col), "records")
    path = map_path or scratch_path(spark, "slot_map")
    if version is None:
        version = 1
        save_map(build_map(slot_totals(records.select("size", "slot_id")), n_shards, version), path)
    return assign(records, load_map(spark, path, version), [id_col, "text_crc32", "size"])
