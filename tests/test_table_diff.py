import json
import random

from pyspark.sql import functions as F

from driftline.operators.table_diff import table_differences

SCHEMA = "rec_no bigint, tbl string, payload_id string, payload_content string, msg_time bigint"


def diff(spark, a, b, **kw):
    side = lambda rows: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SCHEMA).withColumns({"bucket": F.lit("clash"), "field": F.lit(1)})
    return sorted(table_differences(side(a), side(b), **kw).collect(), key=str), None


def rows(spark, a, b, **kw):
    return sorted((tuple(r) for r in diff(spark, a, b, **kw)[0]), key=str)


def test_values(spark):
    a = '{"n":1,"f":2.50,"t":"2023-03-01 00:00:05","z":"0000-00-00 00:00:00","e":"","x":null,"s":"Ab","o":{"p":1,"q":[1]},"big":18446744073709551615}'
    b = '{"big":18446744073709551615,"o":{"q":[1],"p":1},"f":25e-1,"n":1.0,"t":"2023-03-01T00:00:05Z","z":"0000-00-00 00:00:00","e":"","s":"Ab","b2":null}'
    assert rows(spark, [("t", "1", "INSERT " + a, 1)], [("t", "1", "UPDATE " + b, 9)]) == []
    c = b.replace('"Ab"', '"ab"').replace('"e":""', '"e":null').replace("615", "614").replace("00:00:05Z", "01:00:05+01:00")
    assert [r[3] for r in rows(spark, [("t", "1", "INSERT " + a, 1)], [("t", "1", "UPDATE " + c, 9)])] == ["big", "e", "s"]


def test_latest_delete_and_nulls(spark):
    a = [("t", "1", 'INSERT {"v":1}', 1), ("t", "1", 'UPDATE {"v":2}', 5), ("t", "2", 'INSERT {"v":1}', 1), ("t", "2", 'DELETE {"v":1}', 2), ("t", "3", None, 1), (None, None, 'INSERT {"v":1}', 1)]
    b = [("t", "1", 'INSERT {"v":2}', 3), ("t", "2", 'INSERT {"v":1}', 1), ("t", "3", 'INSERT {"v":1}', 1), (None, None, 'INSERT {"v":2}', None)]
    assert rows(spark, a, b) == [("t", "2", "missing_in_source", ""), ("t", "3", "value_differs", "v"), (None, None, "value_differs", "v")]
    assert rows(spark, a, []) == sorted([("t", "1", "missing_in_target", ""), ("t", "3", "missing_in_target", ""), (None, None, "missing_in_target", "")], key=str)
    assert rows(spark, [], []) == []


def test_random_against_brute_force(spark):
    rng = random.Random(2)
    make = lambda: {c: rng.choice([1, 1.5, "x", "", None]) for c in "abc"}
    a = {str(i): make() for i in range(400)}
    b = {k: dict(v) for k, v in a.items() if rng.random() > 0.02}
    for k in rng.sample(sorted(b), 15):
        b[k]["b"] = "changed"
    b["new"] = make()
    want = [("t", k, "missing_in_target", "") for k in a if k not in b] + [("t", "new", "missing_in_source", "")]
    want += [("t", k, "value_differs", "b") for k in a if k in b and a[k] != b[k]]
    tell = lambda m: [("t", k, "INSERT " + json.dumps(v), 1) for k, v in m.items()]
    assert rows(spark, tell(a), tell(b)) == sorted(want, key=str)
    assert rows(spark, tell(a), tell(b), rows_per_bucket=10**9) == sorted(want, key=str)
