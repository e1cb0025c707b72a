import random

import pytest
from pyspark.sql import functions as F

from driftline.operators.ordering import running


@pytest.mark.parametrize("bins", [1, 7, 1024])
def test_against_sequential(spark, bins):
    rng = random.Random(bins)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), i * i, rng.choice([None, 1, 2, 3])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, o bigint, v int").withColumn("extra", F.lit(1)).repartition(5)
    got = {r.o: (r.rn, r.total, r.latest, r.before) for r in running(df, ["k"], ["o"], F.col("o"), bins, rn=("row_number",), total=("sum", F.col("v")), latest=("last", F.col("v")), before=("lag", F.col("v"))).collect()}
    state, want = {}, {}
    for k, o, v in rows:
        n, total, latest, before = state.get(k, (0, 0, None, None))
        n, total, latest = n + 1, total + (v or 0), v if v is not None else latest
        want[o] = (n, total, latest, before)
        state[k] = (n, total, latest, v)
    assert got == want


def test_edges(spark):
    empty = spark.createDataFrame([], "k string, o bigint")
    assert running(empty, ["k"], ["o"], F.col("o"), rn=("row_number",)).collect() == []
    one = spark.createDataFrame([("a", None), ("a", 5)], "k string, o bigint")
    assert sorted(r.rn for r in running(one, [], ["o"], F.col("o"), rn=("row_number",)).collect()) == [1, 2]
    with pytest.raises(ValueError):
        running(one, ["k"], ["o"], F.col("o"), x=("median",))


def test_bins_are_even_beside_outliers(spark):
    from driftline.operators.ordering import binned

    df = spark.range(20_000).select(F.when(F.col("id") == 7, F.lit(10**15)).when(F.col("id") == 8, F.lit(-(10**15))).otherwise(F.col("id") * F.col("id")).alias("o"))
    sizes = [r["count"] for r in binned(df, F.col("o"), 16).groupBy("_bin").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 2 * 20_000 / 16


def test_streams_of_any_length(spark, monkeypatch):
    """Short streams are one window, long ones are binned: the same results."""
    from driftline.operators import ordering

    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").alias("k"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    run = lambda: sorted(map(tuple, running(df, ["k"], ["o"], F.col("o"), n=("row_number",), s=("sum", F.col("v"))).collect()), key=str)
    plain = run()
    monkeypatch.setattr(ordering, "PLAIN", 100)
    monkeypatch.setattr(ordering, "ROWS", 150)
    assert run() == plain
