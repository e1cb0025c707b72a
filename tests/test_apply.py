"""Keyed apply semantics against sequential simulators."""

import random

import pytest
from pyspark.sql import functions as F

from driftline.operators import apply

SCHEMA = "pk int, seq bigint, op string, uk int, v int"


def trace(seed, n=60):
    rng = random.Random(seed)
    return [(rng.randint(1, 6), i, rng.choice(["insert", "update", "delete"]), rng.choice([None, 1, 2, 3]), rng.randint(0, 9)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("seed", range(3))
def test_replace_with_unique_keys(spark, seed):
    rows = trace(seed)
    live = {}
    for pk, seq, op, uk, v in rows:
        live.pop(pk, None)
        if op != "delete":
            for other in [k for k, r in live.items() if uk is not None and r[0] == uk]:
                del live[other]
            live[pk] = (uk, v)
    # a row also falls if a write of another key took its value later
    got = {r.pk: (r.uk, r.v) for r in apply.replace_with_unique_keys(frame(spark, rows), ["pk"], "seq", ["uk", "v"], [["uk"]]).collect()}
    assert got == live


@pytest.mark.parametrize("seed", range(3))
def test_insert_ignore(spark, seed):
    rows = trace(seed)
    live = {}
    for pk, _, op, uk, v in rows:
        if op == "delete":
            live.pop(pk, None)
        else:
            live.setdefault(pk, (uk, v))
    assert {r.pk: (r.uk, r.v) for r in apply.insert_ignore(frame(spark, rows), ["pk"], "seq", ["uk", "v"]).collect()} == live


@pytest.mark.parametrize("seed", range(2))
def test_insert_ignore_unique(spark, seed):
    rows = trace(seed)
    live = {}
    for pk, _, op, uk, v in rows:
        if op == "delete":
            live.pop(pk, None)
        elif pk not in live and not (uk is not None and any(r[0] == uk for r in live.values())):
            live[pk] = (uk, v)
    df = frame(spark, rows).withColumn("shard", F.lit(1))
    got = apply.insert_ignore_unique(df, ["pk"], "seq", ["v"], ["uk"], ["shard"]).collect()
    assert {r.pk: (r.uk, r.v) for r in got} == live


@pytest.mark.parametrize("seed", range(2))
def test_conflicts_kept(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randint(1, 4), i, rng.choice(["insert", "update", "update", "delete"]), rng.choice([None, 1]), rng.choice([None, 1])) for i in range(60)]
    state, want = {}, {}
    for pk, seq, op, i, o in rows:
        there = pk in state
        bad = (op == "insert" and there) or (op == "update" and (not there or state[pk] != o))
        want[seq] = bad
        if op == "delete":
            state.pop(pk, None)
        elif not bad:
            state[pk] = i
    got = apply.conflicts_kept(frame(spark, rows), ["pk"], "seq", "uk", "v").collect()
    # an insert over a row leaves the row as it is
    assert {r.seq: r.conflict for r in got} == want


def test_edges(spark):
    empty = frame(spark, [])
    assert apply.replace_rows(empty, ["pk"], "seq", ["v"]).collect() == []
    assert apply.insert_ignore(empty, ["pk"], "seq", ["v"]).collect() == []
    with pytest.raises(ValueError):
        apply.upsert_rows(empty, ["pk"], "seq", ["v"], [["uk"]])
    with pytest.raises(ValueError):
        apply.delete_by_key(empty, empty, [])
    with pytest.raises(ValueError):
        apply.fill_missing(empty, {"pk": ("int", None)})
    got = apply.fill_missing(spark.createDataFrame([(1, None)], "a int, b int"), {"b": ("int", 7), "a": ("bigint", 0), "c": ("string", "d")}).collect()
    assert [tuple(r) for r in got] == [(None, 1, "d")]
    nulls = frame(spark, [(None, 1, "insert", None, None), (None, 2, "update", None, 3)])
    assert [tuple(r) for r in apply.replace_rows(nulls, ["pk"], "seq", ["v"]).collect()] == [(None, 3, 2)]
