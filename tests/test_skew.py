import random

from pyspark.sql import functions as F

from driftline.operators import skew


def test_counts_distinct_and_mode(spark):
    rows = [("a", 1), ("a", 1), ("a", 2), ("a", 2), ("a", None), ("b", None), (None, 7)]
    df = spark.createDataFrame(rows, "k string, v int").withColumn("value", F.lit("clash"))
    vf = skew.value_frequencies(df, ["k"], F.col("v"))
    got = {r.k: (r.n_rows, r.n_distinct, r["mode"], r.mode_n) for r in skew.from_frequencies(vf, ["k"]).collect()}
    assert got == {"a": (5, 2, 1, 2), "b": (1, 0, None, None), None: (1, 1, 7, 1)}


def test_percentiles_are_exact(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("xyz"), int(rng.paretovariate(1) * 10)) for _ in range(4000)] + [("one", 5), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v bigint")
    got = {(r.k, r.p): r.value for r in skew.weighted_percentiles(skew.value_frequencies(df, ["k"], F.col("v")), ["k"], [0.0, 0.5, 0.9, 1.0]).collect()}
    want = {}
    for k in {r[0] for r in rows}:
        v = sorted(x for key, x in rows if key == k and x is not None)
        for p in (0.0, 0.5, 0.9, 1.0):
            if v:
                want[k, p] = v[max(1, -(-int(p * 1000) * len(v) // 1000)) - 1]
    assert got == want


def test_empty(spark):
    vf = skew.value_frequencies(spark.createDataFrame([], "k string, v int"), ["k"], F.col("v"))
    assert skew.from_frequencies(vf, ["k"]).collect() == []
    assert skew.weighted_percentiles(vf, ["k"], [0.5]).collect() == []
