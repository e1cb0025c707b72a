import random

from pyspark.sql import functions as F

from driftline.operators.dedup import MessageStore, gtid, repeated_records

U = "b6638f64-f52c-6ae2-c950-4b3ab68e319e"
SCHEMA = "rec_no bigint, msg_id string, msg_tag string, msg_time bigint"


def repeats(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"kept": F.lit(0), "_h": F.lit("clash")})
    return sorted((r.rec_no, r.kept) for r in repeated_records(df, "rec_no", F.col("msg_id"), F.col("msg_tag"), F.col("msg_time"), **kw).collect())


def test_spellings(spark):
    ids = [f"{U}:101", f" {U.upper()}:0101\n", f"{U.replace('-', '')}:101", f"{{{U}}}: 101", "nonsense", "", None, f"{U}:", f"{U}:1012"]
    got = [r.g for r in spark.createDataFrame([(i,) for i in ids], "i string").select(gtid(F.col("i")).alias("g")).collect()]
    one = U.replace("-", "") + ":101"
    assert got == [one] * 4 + [None] * 4 + [one + "2"]


def test_rules(spark):
    rows = [
        (1, f"{U}:1", "a", 100),
        (2, f"{U}:1", "a", 90),  # smallest time stays
        (3, f"{U}:1", "b", 100),  # another tag
        (4, f"{U}:2", "a", 50),
        (5, f"{U}:2", "a", 50),  # a tie: smallest record stays
        (6, None, "a", 1),
        (7, None, "a", 1),
        (8, f"{U}:3", None, None),
        (9, f"{U}:3", None, 10**9),  # far bucket, null tag, null time last
        (10, "x", "a", 1),
        (11, "x", "a", 1),
    ]
    assert repeats(spark, rows) == [(1, 2), (5, 4), (8, 9)]
    assert repeats(spark, []) == []


def test_random_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, f"{U}:{1 if rng.random() < 0.3 else rng.randint(1, 900)}", rng.choice("ab"), rng.randint(0, 400_000)) for i in range(3000)]
    first = {}
    for r in rows:
        first[r[1:3]] = min(first.get(r[1:3], (1 << 60, 0)), (r[3], r[0]))
    want = sorted((r[0], first[r[1:3]][1]) for r in rows if first[r[1:3]][1] != r[0])
    assert repeats(spark, rows, bucket_s=1000, max_buckets=16) == want


def test_store(spark, tmp_path):
    store = MessageStore(str(tmp_path / "s"), n_words=256)
    one = spark.createDataFrame([(1, f"{U}:1", "a", 5), (2, f"{U}:1", "a", 9), (3, None, "a", 5)], SCHEMA)
    two = spark.createDataFrame([(4, f"{U.upper()}:1", "a", 90_000), (5, f"{U}:2", "a", 5), (6, f"{U}:1", "b", 5)], SCHEMA)
    new = lambda df, i: sorted(r.rec_no for r in store.new_messages(df, "rec_no", F.col("msg_id"), F.col("msg_tag"), F.col("msg_time"), i).collect())
    assert new(one, 0) == [1, 3]
    assert new(two, 1) == [5, 6]
    assert new(two, 1) == [5, 6]  # run again


def test_store_reads_matching_buckets_only(spark, tmp_path):
    """Ids lie in a folder a bucket; compaction keeps what is known."""
    store = MessageStore(str(tmp_path / "s"), n_words=1 << 12)
    row = lambda i, k, at: (i, f"{U}:{k}", "a", at)
    new = lambda rows, i: sorted(r.rec_no for r in store.new_messages(spark.createDataFrame(rows, SCHEMA), "rec_no", F.col("msg_id"), F.col("msg_tag"), F.col("msg_time"), i).collect())
    assert new([row(k, k, 3600 * k) for k in range(20)], 0) == list(range(20))
    assert new([row(30, 7, 5), row(31, 50, 5)], 1) == [31]
    stored, filters = store._stored(spark, 2)
    from driftline.operators.dedup import _hashed, _identified

    probe = _hashed(_identified(spark.createDataFrame([row(40, 7, 0)], SCHEMA), "rec_no", F.col("msg_id"), F.col("msg_tag"), F.col("msg_time")), store.n_words)
    read = store.matching(stored, filters, probe)
    assert [r["_b"] for r in read.collect()] == [7]
    assert all("_b=7/" in f for f in stored.where("_b = 7").inputFiles() if "_b=" in f) or "PartitionFilters" in read._jdf.queryExecution().toString()
    store.compact(spark, 1)
    assert set(store._folders(spark, "batch")) == set() and set(store._folders(spark, "base")) == {1}
    assert new([row(60, 50, 9), row(61, 7, 9), row(62, 99, 9)], 2) == [62]
    store.compact(spark, 2)
    assert new([row(70, 99, 9), row(71, 19, 9)], 3) == []
