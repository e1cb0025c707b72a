"""Streams with state of their own: what a micro-batch alone can't tell.

State is kept by Spark's state store below the query's checkpoint, a row a
key, so it survives restarts and lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def conflicts_kept(changes: DataFrame, keys: Sequence[str], order: str, image: str, old: str) -> DataFrame:
    """(keys, order, op, conflict) as apply.conflicts_kept gives them, on a
    stream: the row each key holds is state.  Changes of a key must come in
    order from one micro-batch to the next; within one they are sorted."""
    src = changes.select(*keys, order, "op", F.col(image).cast("string").alias("_i"), F.col(old).cast("string").alias("_o"))
    out = src.select(*keys, order, "op").withColumn("conflict", F.lit(True)).schema

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        there, image = state.get if state.exists else (False, None)
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        flags = []
        for op, i, o in zip(rows["op"], rows["_i"], rows["_o"]):
            i, o = (None if pd.isna(x) else x for x in (i, o))
            if op == "insert":
                flags.append(there)
                there, image = True, image if there else i
            elif op == "update":
                bad = not there or image != o
                flags.append(bad)
                image = image if bad else i
            else:
                flags.append(False)
                there, image = False, None
        state.update((there, image))
        yield rows[[*keys, order, "op"]].assign(conflict=flags)

    return src.groupBy(*keys).applyInPandasWithState(run, out, "there boolean, image string", "append", GroupStateTimeout.NoTimeout)


def first_deliveries(stream: DataFrame, ids: Sequence[str], event_time: str, horizon: str = "1 hour") -> DataFrame:
    """Each message once: repeats that come within ``horizon`` of event time
    after the first are dropped, and the state of older ones is given up."""
    return stream.withWatermark(event_time, horizon).dropDuplicatesWithinWatermark(list(ids))


def latency_windows(stream: DataFrame, event_time: str, latency_s: Column, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """(start, n, mean_s, most_s) of each window of event time.  In append mode
    a window comes out when ``late`` has passed it, in complete mode always."""
    return stream.withWatermark(event_time, late).groupBy(F.window(event_time, width).alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.avg(latency_s).alias("mean_s"), F.max(latency_s).alias("most_s")).select(F.col("_w.start").alias("start"), "n", "mean_s", "most_s")
