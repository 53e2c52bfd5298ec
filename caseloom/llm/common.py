"""What several corpus operators share: words, shingles and shared scratch tables."""

from __future__ import annotations

import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
#: Rows turned into Python objects at once, so that a batch of long texts stays small.
SLICE_ROWS = 128

_WORD_CACHE_ENTRIES = 150_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], dtype=np.uint64)


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``. A default is set only where it is unset on one machine; on a cluster that is an error, since workers would not share it."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/caseloom-{uuid.uuid4().hex}/{name}"


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and losing an executor costs nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What Spark hands a Python worker at once: few texts, and no more than so many bytes unless one text is longer.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of bounded size, which the session's settings carry: texts may be long, and a worker's memory is not."""
    bound_batches(df.sparkSession)
    return df.mapInArrow(function, schema)


def bound_batches(spark: SparkSession) -> None:
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


#: Bits of a key bitmap: 4 MB in all, whatever number of keys it holds.
BITMAP_BITS = 1 << 25


def key_bitmap(keys: DataFrame, key: str) -> DataFrame:
    """A fixed-size bitmap of a long column, in at most 1024 rows (bucket, bits): small enough to broadcast at any scale."""
    bit = F.pmod(F.col(key), F.lit(BITMAP_BITS))
    return keys.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))


def bitmap_bucket(key: Column) -> Column:
    return F.bitmap_bucket_number(F.pmod(key, F.lit(BITMAP_BITS)))


def bitmap_may_hold(bits: Column, key: Column) -> Column:
    """False only for keys that the bitmap was not built from."""
    bit = F.bitmap_bit_position(F.pmod(key, F.lit(BITMAP_BITS)))
    byte = F.conv(F.hex(F.substring(bits, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))


def without_rows(docs: DataFrame, rejected: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose id and text are in ``rejected`` (id, text_key); a null id or text is a value like any other.

    Rows that a bitmap of the rejected ones rules out pass straight through; only
    the others, few unless the bitmap is full, are shuffled for the exact anti join.
    """
    keys = stash(rejected.select(F.col(id_col).alias("rejected_id"), F.col("text_key").alias("rejected_key")).distinct(), "rejected")
    bitmap = key_bitmap(keys.select(F.xxhash64("rejected_id", "rejected_key").alias("k")), "k").alias("b")
    text_key = F.xxhash64(F.col(f"d.`{text_col}`"))
    key = F.xxhash64(F.col(f"d.`{id_col}`"), text_key)
    marked = docs.alias("d").join(F.broadcast(bitmap), bitmap_bucket(key) == F.col("b.bucket"), "left")
    may = bitmap_may_hold(F.col("b.bits"), key)
    passed = marked.where(~may).select("d.*")
    same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("r.rejected_id")) & (text_key == F.col("r.rejected_key"))
    checked = marked.where(may).select("d.*").alias("d").join(keys.alias("r"), same, "left_anti").select("d.*")
    return passed.unionByName(checked)


def n_words(text: Column) -> Column:
    """Words of a text as a long; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _WORD_CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def finalise(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hashed_words(text: bytes | None, cache: WordHashes) -> np.ndarray:
    """Hashes of the words of a UTF-8 text, A-Z lower-cased (``bytes.lower`` and ``bytes.split`` know ASCII only)."""
    words = text.lower().split() if text else []
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of ``size`` words (at most five), in order."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total += words[i : i + n] * _FACTORS[i]
    return finalise(total)


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingles: windows of five words, or the whole sequence where it is shorter."""
    if len(words) == 0:
        return np.empty(0, np.uint64)
    return np.unique(grams(words, min(SHINGLE_WORDS, len(words))))


def common_size(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == 0:
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))
