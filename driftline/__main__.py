"""python -m driftline PIPELINE.json|toml [--status | --reset | --health]

Runs a pipeline, or tells its stored position, or forgets it, or tells
whether it moved within the last minute.

input: {"format": "parquet" | "json" | ... | "kafka" | a plugin's name,
        "path": ... | "servers": ..., "topic": ...,
        "mode": "batch" | "stream" | "replication", "checkpoint": ...,
        "snapshot": {"format": ..., "path": ...}, "start": a sequence number}
output: {"sink": "parquet", "options": {...}, "routes": [...],
         "engine": "replace" | "insert-ignore" | "upsert" | a plugin's name,
         "keys": [...], "order": "seq", "columns": [...], "buckets": 64}
positions: below "positions" of the input's settings, a folder.

With keys and order, changes are folded by the engine into the target's rows,
in a stream into tables below the path of the sink (rows in ``rows``, what
later batches need in ``changes``).  Without them changes are written as they
are, in a stream each batch to its own folder ``batch_id=N``.  A replication
writes the snapshot's rows as inserts first and then follows the log from the
position that was set before the scan; it goes on where it ended.
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline import registry
from driftline.config import Pipeline
from driftline.sources import feeds, sinks
from driftline.streaming.changes import fold_batches, run_to_end, status
from driftline.streaming.positions import MemoryPositions, Position, Positions, PositionStore
from driftline.streaming.tables import KeyedTable

SNAPSHOT_BATCH = 0  # batches of a log are numbered after it


def positions(spark: SparkSession, p: Pipeline) -> Positions:
    if "repo" in p.input:
        return registry.plugin("positionRepo", p.input["repo"])(spark, p.input)
    return PositionStore(spark, p.input["positions"]) if "positions" in p.input else MemoryPositions()


def read(spark: SparkSession, c: dict, streaming: bool) -> DataFrame:
    fmt = c.get("format", c.get("type", "json"))
    if fmt in registry.names("input"):
        return registry.plugin("input", fmt)(spark, c, streaming)
    if fmt == "kafka":
        return feeds.read_kafka(spark, c["servers"], c["topic"], streaming, **c.get("options", {}))
    return feeds.read_changes(spark, c["path"], fmt, streaming, **c.get("options", {}))


def run(spark: SparkSession, p: Pipeline) -> dict:
    """Runs to the end of the input and returns the pipeline's status."""
    name, options = p.output.get("sink", p.output.get("type", "discard")), p.output.get("options", {})
    sink = sinks.SINKS[name] if name in sinks.SINKS else registry.plugin("output", name)
    folded = bool(p.output.get("keys") and p.output.get("order"))
    if not folded and "engine" in p.output:
        raise ValueError("an engine needs keys and order")
    mode = p.input.get("mode", "batch")
    if mode not in ("batch", "stream", "replication"):
        raise ValueError(f"unknown mode {mode!r}")
    store = positions(spark, p)
    at = store.get(p.name, p.input.get("start"))
    if mode == "batch":
        changes = read(spark, p.input, False)
        sink(p.folded(changes) if folded else p.transform(changes), **options)
        store.put(Position(p.name, "ended", at.start, at.value))
        return {"name": p.name, "config": p.hash(), "stage": "ended"}

    def each(batch: DataFrame, batch_id: int) -> None:
        if name == "parquet":
            # run again, a batch replaces its own folder only
            sink(p.transform(batch), **options | {"path": f"{options['path'].rstrip('/')}/batch_id={batch_id}", "mode": "overwrite"})
        else:
            sink(p.transform(batch), **options)

    write = each
    if folded:
        if name != "parquet":
            raise ValueError(f"sink {name!r} holds no rows to fold into; a folded stream needs parquet")
        path, keys, buckets = options["path"].rstrip("/"), ["tgt_db", "tgt_tbl", *p.output["keys"]], p.output.get("buckets", 64)
        write = fold_batches(KeyedTable(spark, f"{path}/changes", keys, buckets), KeyedTable(spark, f"{path}/rows", keys, buckets), p)
    later = write
    if mode == "replication":
        if at.stage == "batch":
            first = read(spark, p.input["snapshot"], False).withColumn("op", F.lit("insert"))
            if p.output.get("order"):
                first = first.withColumn(p.output["order"], F.lit(-1).cast("bigint"))
            write(first, SNAPSHOT_BATCH)
            at = Position(p.name, "stream", at.start, at.value, ["snapshot"])
            store.put(at)

        def later(batch: DataFrame, batch_id: int) -> None:
            # the log is read from the position taken before the scan
            after = batch if at.start is None else batch.where(F.col(p.output.get("order", "seq")) > at.start)
            write(after, batch_id + SNAPSHOT_BATCH + 1)

    q = run_to_end(read(spark, p.input, True), p.input["checkpoint"], later)
    out = status(q, p.name, p.hash())
    store.put(Position(p.name, "stream", at.start, out["position"], at.done))
    return out


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(prog="driftline", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    a.add_argument("config")
    what = a.add_mutually_exclusive_group()
    for flag in ("--status", "--reset", "--health"):
        what.add_argument(flag, action="store_true")
    args = a.parse_args(argv)
    spark, p = SparkSession.builder.getOrCreate(), Pipeline.load(args.config)
    if args.reset:
        positions(spark, p).reset(p.name)
        out: dict = {"name": p.name, "reset": True}
    elif args.status or args.health:
        at = positions(spark, p).get(p.name, p.input.get("start"))
        out = {"name": p.name, "config": p.hash(), "stage": at.stage, "position": at.value, "version": at.version}
        if args.health:
            out = {"name": p.name, "healthy": time.time() - at.updated <= 60}
    else:
        out = run(spark, p)
    print(json.dumps(out, default=str))


if __name__ == "__main__":
    main()
