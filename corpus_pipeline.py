"""Documents to training shards: quality rules, near duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of documents; the last returns where each row goes. A
stage that filters keeps rows as they are. Rows are told apart by id and text, so
repeated rows share a decision. A null id is no identity: such rows are dropped
by rules that reject their text, and are never taken for duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import decontamination, mixing, near_dedup, quality_rules, sharding
from caseloom.llm.common import stash, without_rows
from caseloom.llm.queries import SHARDS, WEIGHTS, pipeline_sql

#: DuckDB SQL for the rows of run().
ORACLE_SQL = pipeline_sql()


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the base rules or the line-frequency verdict reject."""
    return without_rows(docs, quality_rules.judge(docs).where(~F.col("kept")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each component the document with the least id."""
    return without_rows(docs, near_dedup.near_duplicates(docs).where(~F.col("kept")))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without_rows(docs, decontamination.contained_items(docs, items))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it: not at all, once or twice."""
    return mixing.repeat(docs, WEIGHTS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and the position in it of every copy."""
    placed = sharding.shard_documents(docs, SHARDS)
    return placed.select("doc_id", "size", "text_crc32", "shard", "slot", "slot_id", "version")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
