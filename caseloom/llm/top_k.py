"""Exact top-k search by inner product, by a three-phase uniform threshold.

Vectors become integers, floor(scale * x), so that scores are exact and ties are
real. The components are dealt into ``lists`` slices, and a score is the sum of
its partial scores, one a slice. Every task (a part of the candidates) holds one
list of partial scores a slice:

1. It gathers the best entries of its local lists and gives the scores of the k
   best of them. The k-th best over all tasks is a lower bound of the final k-th
   score: the safe cutoff.
2. The cutoff is broadcast, a number a query. An entry whose partial scores all lie
   below ``cutoff / lists`` scores below the cutoff, so entries with a partial score
   at or above that uniform threshold are sufficient. They are collected.
3. What remains of their scores is resolved exactly; those that reach the cutoff
   go on, the k best of a task at most, and the k best over all tasks are the
   result.

So what is shuffled is k narrow rows a query and task, twice, and never a pair that
cannot matter. Queries go in blocks of bounded bytes; a block and its cutoffs are
all that is ever broadcast or sent through the driver. A block's result is written
to the shared folder before the next block begins.

Equal vectors are searched once: candidates are grouped into classes of equal
vectors, each with its k + 1 least ids (more cannot be among the k best of any
query), and so are queries. So a vector that a third of all rows share costs no
more than any other.

Nulls and odd input: vectors that are null, or hold a null, NaN or infinite
component, take no part. A null id is a candidate that comes last among ties, and no
query. Vectors of other lengths meet as if the shorter ended in zeros. Repeated
rows are rows of their own: a query leaves out itself only, and each query row gives
its own result. With fewer than k other rows, all are returned; an empty table gives
no rows. Components beyond 32 bits after scaling and scores beyond 64 bits raise
an error. Columns other than id and vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stash

SCALE = 64
LISTS = 4
#: Bytes of the queries that are searched, and so broadcast, at once.
BLOCK_BYTES = 4 << 20
#: Scores that a task holds at once: queries of a block times candidates of a part.
_PART_SCORES = 2 << 20
#: No score; its negative is a long too.
_LEAST = 1 - (1 << 63)


def integer_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, vector): components as integers; only rows whose components are all finite."""
    component = lambda x: x.cast("double")
    finite = lambda x: component(x).isNotNull() & ~F.isnan(component(x)) & (F.abs(component(x)) < float("inf"))
    whole = F.transform(F.col(vector_col), lambda x: F.floor(component(x) * F.lit(float(scale))).cast("int"))
    return rows.where(F.col(vector_col).isNotNull() & F.forall(vector_col, finite)).select(F.col(id_col).alias("id"), whole.alias("vector"))


def _classes(rows: DataFrame, keep: int) -> DataFrame:
    """(vector, least, members): a row for each distinct vector; ``members`` (id, row) holds its ``keep`` first, by id. ``least`` orders classes that tie."""
    by_id = Window.partitionBy("vector").orderBy(F.col("id").asc_nulls_last(), "row")
    first = rows.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= keep)  # limited before the shuffle too
    member = F.struct(F.col("id").isNull().alias("no_id"), "id", "row")
    return first.groupBy("vector").agg(F.array_sort(F.collect_list(member)).alias("members")).withColumn("least", F.col("members")[0])


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, short ones ended by zeros."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy()
    out = np.zeros((len(vectors), width), np.int64)
    out[np.repeat(np.arange(len(vectors)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _exact_type(queries: np.ndarray, rows: np.ndarray):
    """The fastest number type in which every score and partial score is exact."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * queries.shape[1]
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


def _slices(width: int, lists: int) -> list[slice]:
    """The components of each list; a list may be empty where there are fewer components."""
    bounds = [width * i // lists for i in range(lists + 1)]
    return [slice(a, b) for a, b in zip(bounds, bounds[1:], strict=False)]


def _parts(batches: Iterator[pa.RecordBatch], block: np.ndarray, lists: int):
    """(key of each candidate, partial scores a list, scores) of parts of the candidates against a block of queries."""
    n, width = block.shape
    size = max(1, _PART_SCORES // max(1, n))
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            held = part.column("vector")
            longest = int(np.diff(held.offsets.to_numpy()).max(initial=0))
            rows = _matrix(held, max(width, longest))[:, :width]  # components that no query has add nothing
            kind = _exact_type(block, rows)
            left, right = block.astype(kind), rows.astype(kind)
            partial = [left[:, s] @ right[:, s].T for s in _slices(width, lists)]
            total = sum(partial[1:], partial[0])
            if kind is object and total.size and (max(total.max(), -total.min()) >= 1 << 63):
                raise OverflowError("an inner product does not fit a long")
            yield part, partial, total


def _best_of(values: np.ndarray, k: int) -> np.ndarray:
    return values if values.shape[1] <= k else -np.partition(-values, k - 1, axis=1)[:, :k]


def _gather_function(shared, lists: int, k: int):
    """Phase 1: of a task, for each query, the scores of the k best entries of its local lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        best = np.empty((len(block), 0), np.int64)
        for part, partial, total in _parts(batches, block, lists):
            listed = np.ones(total.shape, bool)
            if part.num_rows > k:
                listed[:] = False
                for scores in partial:
                    np.put_along_axis(listed, np.argpartition(-scores, k - 1, axis=1)[:, :k], True, axis=1)
            most = int(listed.sum(axis=1).max(initial=0))
            where = np.argsort(~listed, axis=1, kind="stable")[:, :most]  # the listed ones first
            taken = np.where(np.take_along_axis(listed, where, axis=1), np.take_along_axis(total, where, axis=1).astype(np.int64), _LEAST)
            best = _best_of(np.concatenate([best, taken], axis=1), k)
        query, nth = np.nonzero(best > _LEAST)
        if len(query):
            yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), pa.array(best[query, nth], pa.int64())], ["query", "score"])

    return run


def _collect_function(shared, lists: int, k: int):
    """Phases 2 and 3: entries with a sufficient partial score, resolved; those that reach the cutoff, the k best of a part at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, cutoffs = shared.value
        for part, partial, total in _parts(batches, block, lists):
            threshold = -(-cutoffs // lists)  # partial scores are integers
            sufficient = np.zeros(total.shape, bool)
            for scores in partial:
                sufficient |= scores >= threshold[:, None]
            sufficient &= total >= cutoffs[:, None]
            query, row = np.nonzero(sufficient)
            score = total[query, row].astype(np.int64)
            keys = part.column("least")
            no_id, ids, rows = (keys.field(i) for i in range(3))
            last = no_id.to_numpy(zero_copy_only=False)[row]
            order = np.lexsort((rows.to_numpy()[row], ids.fill_null(0).to_numpy(zero_copy_only=False)[row], last, -score, query))
            query, row, score = query[order], row[order], score[order]
            starts = np.searchsorted(query, query)  # the first entry of each query
            top = np.arange(len(query)) - starts < k
            columns = [pa.array(query[top], pa.int32()), pa.array(score[top], pa.int64()), part.column("members").take(pa.array(row[top]))]
            yield pa.RecordBatch.from_arrays(columns, ["query", "score", "members"])

    return run


def _highest(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, limited in every task before they are shuffled; ``rank`` counts them from 1."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def _search_block(classes: DataFrame, block: np.ndarray, lists: int, k: int, member_type: str) -> DataFrame:
    """(query, best): for each query of a block, by its number in it, its k best rows in order."""
    context = classes.sparkSession.sparkContext
    shared = context.broadcast(block)
    gathered = map_batches(classes.select("vector"), _gather_function(shared, lists, k), "query int, score long")
    kth = _highest(gathered, ["query"], [F.col("score").desc()], k).where(F.col("rank") == k)
    cutoffs = np.full(len(block), _LEAST, np.int64)
    for row in kth.select("query", "score").toLocalIterator():  # a number a query of the block
        cutoffs[row["query"]] = row["score"]
    both = context.broadcast((block, cutoffs))
    found = map_batches(classes, _collect_function(both, lists, k), f"query int, score long, members array<{member_type}>")
    rows = found.select("query", "score", F.explode("members").alias("m")).select("query", "score", "m.no_id", "m.id", "m.row")
    ranked = _highest(rows, ["query"], [F.col("score").desc(), "no_id", "id", "row"], k)
    best = stash(ranked.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "id", "row"))).alias("best")), "top")  # k entries at most
    shared.destroy()
    both.destroy()
    return best


def top_k(rows: DataFrame, is_query: Column, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, lists: int = LISTS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, id, score): for each row that ``is_query`` (a column over ``id``) names, the k other rows of the highest scores, ties by least id."""
    numbered = stash(integer_vectors(rows, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    classes = stash(_classes(numbered, k + 1), "classes")
    asked = numbered.where(F.col("id").isNotNull() & is_query)
    distinct = stash(asked.groupBy("vector").agg(F.min("row").alias("least_row")), "asked")
    facts = distinct.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("width")).first()
    n_blocks = max(1, math.ceil(facts["n"] * max(1, facts["width"] or 0) * 8 / block_bytes))
    dealt = stash(distinct.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(n_blocks)).cast("int")), "blocks")
    member_type = classes.schema["least"].dataType.simpleString()
    found = None
    for nth in range(n_blocks if facts["n"] else 0):
        part = dealt.where(F.col("block") == nth).select("vector", "least_row").toArrow()  # bounded by block_bytes
        keys, vectors = part.column("least_row").to_pylist(), part.column("vector").combine_chunks()
        if not keys:
            continue
        block = _matrix(vectors, max(1, facts["width"]))
        best = _search_block(classes, block, lists, k + 1, member_type)
        names = classes.sparkSession.createDataFrame(pa.table({"query": pa.array(range(len(keys)), pa.int32()), "least_row": pa.array(keys, pa.int64())}))
        best = best.join(F.broadcast(names), "query").drop("query")
        found = best if found is None else found.unionByName(best)
    if found is None:
        entry = f"struct<rank: int, score: bigint, id: {numbered.schema['id'].dataType.simpleString()}, row: bigint>"
        found = classes.sparkSession.createDataFrame([], f"best array<{entry}>, least_row long")
    queries = asked.join(distinct, "vector").select(F.col("id").alias("query_id"), F.col("row").alias("query_row"), "least_row")
    # each class of queries has one row of results, so that a hot class is a plain join that can be split
    others = queries.join(found, "least_row").select("query_id", F.slice(F.filter("best", lambda b: b["row"] != F.col("query_row")), 1, k).alias("best"))
    entries = others.select("query_id", F.posexplode("best").alias("at", "b"))
    return entries.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.id").alias(id_col), F.col("b.score").alias("score"))
