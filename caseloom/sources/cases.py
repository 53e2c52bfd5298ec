"""Case folders as tables: their JSON documents side by side, calibration texts, carried line numbers, restored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def load_documents(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """A row per case folder with one variant column per JSON document ``<name>.json`` in it (null if it is absent or not JSON)."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True)
    path = F.col("_metadata.file_path")
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.json$", "")
    found = raw.select(F.regexp_replace(path, "/[^/]*$", "").alias("case"), name.alias("name"), "value").where(F.col("name").isin(names))
    wide = found.groupBy("case").pivot("name", names).agg(F.first("value"))
    return wide.select("case", *[F.try_parse_json(n).alias(n) for n in names])


def calibration_texts(texts: DataFrame, text: str, n: int, seed: int, least_chars: int = 100) -> DataFrame:
    """The first ``n`` texts of more than ``least_chars`` trimmed characters, in the order of a digest of seed and text; fewer are an error."""
    long_enough = texts.where(F.length(F.trim(text)) > least_chars)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(text)), 256)
    found = long_enough.withColumn("sample_order", order).orderBy("sample_order").limit(n)
    short = F.assert_true(F.count("*") == n, F.lit(f"fewer than {n} texts are long enough"))
    return found.join(F.broadcast(found.agg(short.alias("ok"))).where(F.col("ok").isNull()).drop("ok"))


def carried(lines: DataFrame, group: list[str], sequence: str, value: Column, name: str) -> DataFrame:
    """The last given value up to each line of its group, as a report that names a line once and then speaks of it."""
    w = Window.partitionBy(*group).orderBy(sequence).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn(name, F.last_value(value, F.lit(True)).over(w))


def restored(current: DataFrame, snapshot: DataFrame, key: list[str], history: Column) -> DataFrame:
    """The snapshot's rows, with the current rows that are history and that the snapshot does not have."""
    kept = current.where(history).join(snapshot.select(*key), key, "left_anti")
    return snapshot.unionByName(kept)
