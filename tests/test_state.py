"""Streams with state against the same rows in one batch."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from driftline.operators import apply
from driftline.streaming import state

T0 = datetime(2023, 3, 1)


def run(spark, tmp_path, batches, schema, make, mode="append"):
    """Writes and runs batch after batch over one checkpoint."""
    src, name = str(tmp_path / "in"), f"t{abs(hash(str(tmp_path))) % 10**9}"
    got = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = make(spark.readStream.schema(schema).parquet(src))
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: got.append([tuple(r) for r in df.collect()])).option("checkpointLocation", str(tmp_path / f"c{name}")).trigger(availableNow=True).start()
        q.awaitTermination()
    return got


def test_conflicts_over_batches(spark, tmp_path):
    schema = "pk int, seq bigint, op string, i string, o string"
    batches = [[(1, 2, "update", "b", "a"), (1, 1, "insert", "a", None), (2, 1, "update", "x", None)], [(1, 3, "update", "c", "zzz"), (1, 4, "insert", "d", None), (2, 2, "insert", "y", None)], [(1, 5, "delete", None, None), (1, 6, "insert", "e", None), (2, 3, "update", "z", "y")]]
    got = [r for b in run(spark, tmp_path, batches, schema, lambda s: state.conflicts_kept(s, ["pk"], "seq", "i", "o")) for r in b]
    df = spark.createDataFrame([r for b in batches for r in b], schema)
    assert sorted(got) == sorted(map(tuple, apply.conflicts_kept(df, ["pk"], "seq", "i", "o").collect()))
    assert sum(r[3] for r in got) == 3


def test_first_deliveries(spark, tmp_path):
    schema = "stream_key string, seq bigint, ts timestamp"
    at = lambda m: T0 + timedelta(minutes=m)
    batches = [[("s", 1, at(0)), ("s", 1, at(0)), ("s", 2, at(1))], [("s", 2, at(1)), ("t", 2, at(2))]]
    got = [r[:2] for b in run(spark, tmp_path, batches, schema, lambda s: state.first_deliveries(s, ["stream_key", "seq"], "ts")) for r in b]
    assert sorted(got) == [("s", 1), ("s", 2), ("t", 2)]


def test_latency_windows(spark, tmp_path):
    schema = "ts timestamp, s double"
    batches = [[(T0, 1.0), (T0 + timedelta(seconds=70), 5.0)], [(T0 + timedelta(seconds=10), 3.0)]]
    last = run(spark, tmp_path, batches, schema, lambda s: state.latency_windows(s, "ts", F.col("s")), "complete")[-1]
    assert sorted(r[1:] for r in last) == [(1, 5.0, 5.0), (2, 2.0, 3.0)]
