"""Streams of changes: the batch operators inside foreachBatch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.functions.joins import null_safe_join
from driftline.functions.times import micros
from driftline.streaming.tables import KeyedTable


def apply_batches(target: KeyedTable, order: str, columns: Sequence[str], transform: Callable[[DataFrame], DataFrame] = lambda df: df, forget: Callable[[DataFrame], Column] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: filters and routes a batch, then folds it into
    the target, last writer wins.  Deletes leave a tombstone, so a late write
    with a lower order can't bring a row back; ``forget`` tells which
    tombstones are old enough to go."""
    keys = target.keys

    def fold(rows: DataFrame) -> DataFrame:
        last = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns, "op", order), order).alias("_r")).select(*keys, "_r.*")
        return last if forget is None else last.where(~F.coalesce((F.col("op") == "delete") & forget(last), F.lit(False)))

    def run(batch: DataFrame, batch_id: int) -> None:
        target.merge(transform(batch).select(*keys, *columns, "op", order), batch_id, fold)

    return run


def fold_batches(changes: KeyedTable, rows: KeyedTable, pipeline) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: folds a batch into the target's rows by the
    pipeline's engine.  ``changes`` keeps what later batches need: the last
    change of each key, and for insert-ignore, where a late delete can let a
    later write in, the last delete and all writes after it.  Both tables have
    the same buckets; only those of the batch are read and written."""
    keys, order = changes.keys, pipeline.output["order"]

    def kept(df: DataFrame) -> DataFrame:
        if pipeline.output.get("engine", "replace") != "insert-ignore":
            rest = [c for c in df.columns if c not in keys]
            return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")
        last = df.where("op = 'delete'").groupBy(*keys).agg(F.max(order).alias("_d"))
        live = null_safe_join(df, last, keys, "left").where(F.col("_d").isNull() | (F.col(order) >= F.col("_d")))
        return live.select(*df.columns).dropDuplicates([*keys, order])

    def run(batch: DataFrame, batch_id: int) -> None:
        touched = changes.merge(pipeline.flat(batch), batch_id, kept)
        if touched:
            rows.put(pipeline.rows(changes.read(batch_id + 1, touched)), touched, batch_id)

    return run


def run_to_end(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]):
    """Runs a stream over all that is there and returns the ended query."""
    q = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def live_rows(target: KeyedTable) -> DataFrame:
    return target.read().where("op <> 'delete'").drop("op")


def status(query, name: str, config: str = "") -> dict:
    """Name, settings, position and rows of a running or ended stream."""
    p = query.lastProgress
    return {
        "name": name,
        "config": config,
        "stage": "running" if query.isActive else "ended",
        "position": [s["endOffset"] for s in p["sources"]] if p else None,
        "batch": p["batchId"] if p else None,
        "rows": p["numInputRows"] if p else None,
    }


def is_healthy(watermark: Column, now: Column, limit_s: int = 60) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(watermark) <= limit_s


def heartbeats(spark, name: str, per_second: int = 1) -> DataFrame:
    """An endless probe: rows (name, offset, update_time_at_source) to be
    written to the source; they come back in its log."""
    ticks = spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
    return ticks.select(F.lit(name).alias("name"), F.col("value").alias("offset"), F.col("timestamp").alias("update_time_at_source"))


def probe_latency(seen: DataFrame, name: str, sent: str, received: str) -> DataFrame:
    """(name, n, offset, least_s, mean_s, p95_s, most_s) of probes that came back."""
    s = (micros(received) - micros(sent)) / 1_000_000
    return seen.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.max("offset").alias("offset"), F.min(s).alias("least_s"), F.avg(s).alias("mean_s"), F.percentile(s, 0.95).alias("p95_s"), F.max(s).alias("most_s"))


def drop_repeated_ddl(ddl: DataFrame, table: str, ts: str, within_s: int = 30) -> DataFrame:
    """Drops a statement on a table within ``within_s`` of the last one kept.
    Each step depends on the one before, so statements, which are few, are
    replayed by table in sorted partitions with one time a table as state."""
    import pyarrow as pa

    names = ddl.columns

    def run(batches):
        current, kept = None, None
        for b in batches:
            keep = []
            for t, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t != current or kept is None:
                    current, kept = t, None
                stays = kept is None or at is None or at - kept > within_s * 1_000_000
                kept = at if stays and at is not None else kept
                keep.append(stays)
            yield pa.RecordBatch.from_arrays(b.columns[2:], names=names).filter(pa.array(keep, pa.bool_()))

    placed = ddl.select(F.col(table).alias("_k"), micros(ts).alias("_at"), *names)
    return placed.repartition("_k").sortWithinPartitions("_k", "_at").mapInArrow(run, ddl.schema)
