"""Result logs as a stream: append, keep the latest row of each case, summarise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.select import latest

#: Parts of a kept table by hash of the key: a batch rewrites only the parts that its keys fall into.
BUCKETS = 64


def result_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A file stream of JSON lines, some files a batch, broken lines as nulls."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).json(folder)


def keep_latest(stream: DataFrame, key: str, sequence: str, target: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest row of each key so far in a table of ``BUCKETS`` parts.

    A batch reads the parts that its keys fall into, as they stood before it, and
    writes their next versions; the other parts stay. The same batch run again
    writes the same versions, so a failed run can be repeated.
    """

    def upsert(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(F.col(key).isNotNull()).withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
        touched = rows.select("bucket").distinct()
        if epoch > 0:
            before = _newest(spark, target, rows.schema, epoch).join(F.broadcast(touched), "bucket", "left_semi")
            rows = before.select(*rows.columns).unionByName(rows)
        kept = latest(rows, [key], [sequence]).withColumn("epoch", F.lit(epoch))
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "epoch").parquet(target)

    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _newest(spark: SparkSession, target: str, schema: StructType, before: int | None = None) -> DataFrame:
    fields = [f for f in schema.fields if f.name not in ("bucket", "epoch")]
    stored = spark.read.schema(StructType([*fields, *StructType.fromDDL("bucket int, epoch int").fields])).parquet(target)
    if before is not None:
        stored = stored.where(F.col("epoch") < before)
    newest = stored.groupBy("bucket").agg(F.max("epoch").alias("epoch"))
    return stored.join(F.broadcast(newest), ["bucket", "epoch"])


def read_latest(spark: SparkSession, target: str, schema: StructType) -> DataFrame:
    """The rows that ``keep_latest`` holds: the newest version of every part."""
    return _newest(spark, target, schema).drop("bucket", "epoch")


def windowed_counts(stream: DataFrame, time: str, late: str, length: str, keys: list[str]) -> DataFrame:
    """Events per window and key, with a bound on late data."""
    return stream.withWatermark(time, late).groupBy(F.window(time, length), *keys).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, time: str, late: str, gap: str, key: str) -> DataFrame:
    """Runs of events of a key without a gap."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), key).agg(F.count("*").alias("n"))


def write_windows(rows: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write a stream's batches until its input is read: all rows so far (``complete``) or those that are closed (``append``)."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    return rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_windows(spark: SparkSession, target: str, schema: StructType, every: bool = False) -> DataFrame:
    """What ``write_windows`` wrote: the last batch of a complete stream, or ``every`` batch."""
    stored = spark.read.schema(StructType([*schema.fields, *StructType.fromDDL("epoch int").fields])).parquet(target)
    if every:
        return stored.drop("epoch")
    last = stored.agg(F.max("epoch").alias("epoch"))
    return stored.join(F.broadcast(last), "epoch").drop("epoch")
