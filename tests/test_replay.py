"""Ordered replay against a sequential simulator."""

import json
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from driftline.operators.replay import current_rows, keyed_changes, replay_changes

FEED = "msg_type string, db string, tbl string, event_ts timestamp_ntz, seq_no bigint, stream_key string, dml_op string, pks_json string, data_json string, old_json string"
T0 = datetime(2023, 3, 1)


def simulate(changes, partial):
    rows = {}
    seen = set()
    for key, ts, seq, op, data in sorted(changes, key=lambda c: (c[1], c[2])):
        if (key, ts, seq) in seen:
            continue
        seen.add((key, ts, seq))
        if op == "delete":
            rows.pop(key, None)
        elif op == "update" and partial and key in rows:
            rows[key] = (seq, {**rows[key][1], **data})
        else:
            rows[key] = (seq, dict(data))
    return rows


def trace(rng, n):
    out = []
    for seq in range(n):
        op = rng.choice(["insert", "update", "update", "update", "delete"])
        data = {c: rng.randint(0, 9) for c in rng.sample("abc", rng.randint(1, 3))}
        out.append((rng.choice(["x", "y", "z", "hot", "hot", "hot"]), seq // 3, seq, op, data))
    out += rng.sample(out, n // 4)
    rng.shuffle(out)
    return out


def test_random_traces(spark):
    rng = random.Random(5)
    for partial in (False, True):
        changes = trace(rng, 120)
        rows = [(k, T0 + timedelta(seconds=ts), seq, op, json.dumps(data)) for k, ts, seq, op, data in changes]
        df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, seq bigint, op string, data string").repartition(7)
        got = replay_changes(df, ["k"], F.col("ts"), F.col("seq"), F.lit("s"), F.col("op"), F.col("data"), partial).collect()
        want = simulate(changes, partial)
        assert {r.k: (r.seq, json.loads(r.image)) for r in got} == want


def feed(spark, rows):
    return spark.createDataFrame(rows, FEED)


def row(op, pks, seq, data=None, old=None, ts=0, db="shop", tbl="t", kind="dml"):
    return (kind, db, tbl, T0 + timedelta(seconds=ts), seq, "s0", op, pks, data, old)


def test_changed_key_ends_the_old_row(spark):
    rows = [row("insert", '{"id":1}', 1), row("UPDATE", '{"id":2}', 2, '{"id":2}', '{"id":1}'), row("insert", '{"id":"3"}', 3), row("Delete", '{"id": 3}', 4)]
    got = current_rows(feed(spark, rows)).collect()
    assert [(r.pk, r.seq_no) for r in got] == [("2", 2)]


def test_names_keys_and_order(spark):
    rows = [
        row("insert", '{"b":2,"a":1}', 5, db=" `SHOP`", tbl="T"),
        row("update", '{"a":"1","b":"2"}', 4, old='{"a":1,"b":2}'),
        row("insert", '{"id":18446744073709551615}', 6, ts=1),
    ]
    got = sorted((r.db, r.tbl, r.pk, r.seq_no) for r in current_rows(feed(spark, rows)).collect())
    assert got == [("shop", "t", "18446744073709551615", 6), ("shop", "t", "1|2", 5)]


def test_nulls_empty_and_extra_columns(spark):
    rows = [
        row(None, None, None, db=None, tbl=None, kind="ctl"),
        row("insert", None, 1),
        row("insert", "[]", 2),
        row("insert", "{bad", 3),
        row(None, '{"id":1}', 4),
        row("insert", '{"id":null}', 5),
        row("update", '{"id":9}', 6, data=None, old="{bad"),
    ]
    df = feed(spark, rows).withColumns({"pk": F.lit("clash"), "op": F.lit(1), "image": F.lit("x")})
    got = sorted((r.pk, r.seq_no, r.image) for r in current_rows(df, with_image=True).collect())
    assert got == [("", 5, "{}"), ("9", 6, "{}")]
    assert current_rows(df.where("false")).collect() == []
    assert keyed_changes(df.where("false")).count() == 0


def test_very_long_value(spark):
    big = "x" * 2_000_000
    got = current_rows(feed(spark, [row("insert", '{"id":1}', 1, json.dumps({"id": 1, "v": big}))]), with_image=True).collect()
    assert json.loads(got[0].image)["v"] == big


def test_key_change_brings_the_old_image(spark):
    """The row goes on under its new key with the columns of its old image; what the new key held before is gone."""
    rows = [
        (1, "insert", '{"id":1}', '{"id":1,"a":"x","b":"y"}', None),
        (2, "insert", '{"id":2}', '{"id":2,"a":"other","c":"z"}', None),
        (3, "update", '{"id":2}', '{"id":2,"a":"new"}', '{"id":1,"a":"x","b":"y"}'),
        (4, "update", '{"id":2}', '{"d":null}', '{"id":2}'),
    ]
    df = spark.createDataFrame([("dml", "d", "t", datetime(2023, 3, 1), n, "s", op, k, data, old) for n, op, k, data, old in rows], FEED)
    got = [(r.pk, json.loads(r.image)) for r in current_rows(df, with_image=True).collect()]
    assert got == [("2", {"id": 2, "a": "new", "b": "y", "d": None})]


def test_repeats_that_differ(spark):
    """The same rows come out however the repeats lie."""
    rows = [("dml", "d", "t", T0, 1, "s", "insert", '{"id":1}', t, None) for t in ('{"id":1,"a":"x"}', '{"a": "x", "id": "1"}', '{"id":1,"a":"w"}')]
    images = set()
    for order in ([0, 1, 2], [2, 1, 0], [1, 0, 2]):
        for parts in (1, 3):
            df = spark.createDataFrame([rows[i] for i in order], FEED).repartition(parts)
            images |= {r.image for r in current_rows(df, with_image=True).collect()}
    assert images == {'{"a": "w", "id": "1"}'}


def test_row_moves_on_with_all_it_holds(spark):
    """Partial updates under changing keys: nothing is lost from key to key, and nothing is taken from before an earlier move."""
    rows = [
        (1, "insert", '{"id":1}', '{"id":1,"a":"x","b":"y"}', None),
        (2, "update", '{"id":2}', '{"id":2,"a":"z"}', '{"id":1}'),
        (3, "update", '{"id":2}', '{"c":5}', None),
        (4, "update", '{"id":3}', '{"id":3}', '{"id":2}'),
        (5, "insert", '{"id":1}', '{"id":1,"q":1}', None),
        (6, "update", '{"id":4}', '{"id":4}', '{"id":1}'),
        (7, "update", '{"id":5}', '{"id":5,"only":1}', '{"id":9}'),
    ]
    import itertools

    for order in itertools.islice(itertools.permutations(rows), 0, 5040, 1700):
        df = spark.createDataFrame([("dml", "d", "t", T0, n, "s", op, k, data, old) for n, op, k, data, old in (*order, rows[1])], FEED).repartition(3)
        got = {r.pk: json.loads(r.image) for r in current_rows(df, with_image=True).collect()}
        assert got == {"3": {"id": 3, "a": "z", "b": "y", "c": 5}, "4": {"id": 4, "q": 1}, "5": {"id": 5, "only": 1}}
