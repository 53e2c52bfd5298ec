"""Streams that keep a state for each group: budgets, repeated signatures, and arrivals that come late."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "spent long, calls long, signature string, ended boolean"
_STEP = "spent_before long, calls_before long, stopped boolean"


def until_spent(stream: DataFrame, group: str, sequence: list[str], cost: Column, signature: str, budget: int, calls: int) -> DataFrame:
    """Rows of each group until its budget or its number of calls is spent, or up to and with a row whose signature repeats the one before.

    What a group has spent, its last signature and whether it has ended are its
    state: a few numbers, whatever it has seen, and kept in the checkpoint, so that a
    stream that is started again goes on where it stopped. Rows of a batch are put in
    sequence inside their group; batches follow each other in the order of arrival.
    Adds spent_before, calls_before and ``stopped``, which marks the repeating row.
    """
    names = [group, *[c for c in sequence if c != group], "signature", "cost"]
    narrow = stream.select(group, *[c for c in sequence if c != group], F.coalesce(F.col(signature), F.lit("")).alias("signature"), F.coalesce(cost, F.lit(0)).cast("long").alias("cost"))
    kinds = {f.name: f.dataType.simpleString() for f in narrow.schema}
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + f", {_STEP}"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        spent, made, last, ended = state.get if state.exists else (0, 0, "", False)
        if ended:
            return
        rows = list(parts)
        rows = pd.concat(rows, ignore_index=True) if len(rows) > 1 else rows[0]
        if len(sequence) == 1 and rows[sequence[0]].dtype.kind in "iufM":
            rows = rows.take(np.argsort(rows[sequence[0]].to_numpy(), kind="stable"))
        else:
            rows = rows.sort_values(sequence)
        marks, costs = rows["signature"].to_numpy(), rows["cost"].to_numpy()
        after = spent + np.cumsum(costs)
        before, made_before = after - costs, made + np.arange(len(rows))
        stopped = (marks == np.concatenate(([last], marks[:-1]))) & (marks != "")
        earlier = np.concatenate(([False], np.logical_or.accumulate(stopped)[:-1]))
        inside = (before < budget) & (made_before < calls) & ~earlier
        ended = bool(not inside.all() or stopped.any())
        state.update((int(after[-1]), int(made + len(rows)), str(marks[-1]), ended))
        kept = {n: rows[n].to_numpy()[inside] for n in names}
        yield pd.DataFrame({**kept, "spent_before": before[inside], "calls_before": made_before[inside], "stopped": stopped[inside].astype(bool)})

    return narrow.groupBy(group).applyInPandasWithState(step, schema, _STATE, "append", GroupStateTimeout.NoTimeout)


def in_arrivals(spark: SparkSession, arrivals: list[DataFrame], folder: str, start: Callable[[DataFrame], StreamingQuery]) -> None:
    """Write arrivals one after the other to a folder, and after each run the stream over the folder until its input is read.

    Every run after the first is a restart from the checkpoint that ``start`` names.
    """
    for rows in arrivals:
        rows.write.mode("append").parquet(folder)
        query = start(spark.readStream.schema(rows.schema).parquet(folder))
        query.awaitTermination()
