"""Targets, positions, plugins and the command line."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from driftline import registry
from driftline.config import Pipeline, config_hash
from driftline.functions import gtid, scalar
from driftline.functions.options import option
from driftline.functions.retarget import annotated
from driftline.operators import changes, documents, routing, snapshot, verify
from driftline.streaming import changes as streaming
from driftline.streaming.positions import MemoryPositions, Position, PositionStore, SnapshotPosition, TablePositions
from driftline.streaming.tables import KeyedTable


def test_merge_touches_its_buckets_only(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["pk"], 32)
    each = streaming.apply_batches(t, "seq", ["v"])
    each(spark.range(500).select(F.col("id").alias("pk"), F.col("id").alias("v"), F.lit("insert").alias("op"), F.col("id").alias("seq")), 0)
    before = t.manifest()
    each(spark.createDataFrame([(7, 70, "update", 900), (8, 0, "delete", 901)], "pk bigint, v bigint, op string, seq bigint"), 1)
    after = t.manifest()
    assert 1 <= len([b for b in after if after[b] != before[b]]) <= 2
    rows = {r.pk: r.v for r in streaming.live_rows(t).collect()}
    assert len(rows) == 499 and rows[7] == 70 and 8 not in rows
    each(spark.createDataFrame([(8, 5, "update", 899)], "pk bigint, v bigint, op string, seq bigint"), 2)  # late: the tombstone stands
    assert 8 not in {r.pk for r in streaming.live_rows(t).collect()}
    for i in range(3, 9):
        each(spark.createDataFrame([(i, 1, "update", 1000 + i)], "pk bigint, v bigint, op string, seq bigint"), i)
    assert streaming.live_rows(t).count() == 500  # 8 is written again
    t.reset()
    assert t.read() is None


def test_old_tombstones_go(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "t"), ["pk"], 4)
    each = streaming.apply_batches(t, "seq", ["v"], forget=lambda df: F.col("seq") < 10)
    each(spark.createDataFrame([(1, 1, "delete", 5), (2, 1, "delete", 50), (3, 1, "insert", 1)], "pk int, v int, op string, seq bigint"), 0)
    assert sorted(r.pk for r in t.read().collect()) == [2, 3]


def change(seq, op, id_, a):
    return ("s", seq, "dml", "d", "t", None, op, {"a": a}, None, {"id": id_}, 1)


def test_replication(spark, tmp_path):
    """Snapshot first, then the log from the position before it; a second run goes on from there."""
    from driftline.__main__ import run
    from driftline.sources.feeds import ENVELOPE

    write = lambda rows, to: spark.createDataFrame(rows, ENVELOPE).coalesce(1).write.mode("append").parquet(str(tmp_path / to))
    write([change(None, None, "1", "s"), change(None, None, "2", "s"), change(None, None, "3", "s")], "snap")
    write([change(9, "update", "1", "too early"), change(11, "delete", "2", None), change(12, "update", "3", "x")], "log")
    conf = {
        "name": "r",
        "input": {"format": "parquet", "path": str(tmp_path / "log"), "mode": "replication", "checkpoint": str(tmp_path / "c"), "snapshot": {"format": "parquet", "path": str(tmp_path / "snap")}, "start": 10, "positions": str(tmp_path / "pos")},
        "output": {"sink": "parquet", "options": {"path": str(tmp_path / "out")}, "engine": "replace", "keys": ["id"], "order": "seq", "columns": ["a"]},
    }
    p = Pipeline.of(conf)
    rows = lambda: {(r.id, r.a) for r in KeyedTable(spark, str(tmp_path / "out/rows"), ["tgt_db", "tgt_tbl", "id"]).read().collect()}
    assert run(spark, p)["stage"] == "ended"
    assert rows() == {("1", "s"), ("3", "x")}
    write([change(13, "insert", "4", "y")], "log")
    run(spark, p)
    assert rows() == {("1", "s"), ("3", "x"), ("4", "y")}
    assert PositionStore(spark, str(tmp_path / "pos")).get("r", 10).stage == "stream"


def test_command_line(spark, tmp_path, capsys):
    from driftline.__main__ import main

    path = tmp_path / "p.json"
    path.write_text(json.dumps({"name": "q", "input": {"positions": str(tmp_path / "pos"), "start": 4}}))
    PositionStore(spark, str(tmp_path / "pos")).put(Position("q", "stream", 4, 9))
    main([str(path), "--status"])
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["position"] == 9
    main([str(path), "--health"])
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["healthy"]
    main([str(path), "--reset"])
    main([str(path), "--status"])
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["position"] == 4


def test_plugins(spark, tmp_path):
    from driftline.__main__ import run

    got = []
    registry.register("input", "two rows", replace=True)(lambda s, c, streaming: s.createDataFrame([("d", "t", "insert"), ("d", "u", "insert")], "db string, tbl string, op string"))
    registry.register("output", "list", replace=True)(lambda df, **_: got.extend(r.tbl for r in df.collect()))
    registry.register("matcher", "match-first-letter", replace=True)(lambda v: F.col("tbl").startswith(v))
    p = Pipeline.of({"name": "p", "input": {"format": "two rows"}, "filters": [{"type": "reject", "config": {"match-first-letter": "u"}}], "output": {"sink": "list"}})
    run(spark, p)
    assert got == ["t"]
    with pytest.raises(ValueError):
        registry.register("output", "list")(print)
    with pytest.raises(ValueError):
        registry.register("dashboard", "x")
    with pytest.raises(ValueError):
        registry.plugin("scheduler", "none")


def test_position_stores(spark, tmp_path):
    for store in (MemoryPositions(), TablePositions(spark, "parquet", path=str(tmp_path / "t"))):
        assert store.get("a", start=1) == Position("a", start=1, value=1)
        for n in (5, 6):
            store.put(Position("a", "stream", 1, {"n": n}))
        store.put(Position("b", "batch", 2, 3))
        assert (store.get("a", 1).value, store.get("b").value) == ({"n": 6}, 3)
        store.reset("a")
        assert store.get("a").value is None and store.get("b").value == 3


def test_snapshot_positions():
    old = {"start-binlog": {"gtid": "u:1-5"}, "table-stats": {"d.t": {"max": {"column": "id", "value": 9}, "min": {"column": "id", "value": 1}, "current": None, "estimated-count": 8, "scanned-count": 3, "done": False}}}
    p = SnapshotPosition.decode(json.dumps(old))
    assert p.tables["d.t"].greatest == [{"column": "id", "value": 9}] and p.tables["d.t"].current is None and p.tables["d.t"].read == 3
    assert SnapshotPosition.decode(p.encode()) == p
    with pytest.raises(ValueError):
        SnapshotPosition.decode('{"schema-version": "v9"}')


def test_scan_in_pages(spark):
    df = spark.createDataFrame([(a, b) for a in range(5) for b in range(5)], "a int, b int")
    seen, ends = [], []
    for last, page in snapshot.full_scan(df, ["a", "b"], 7):
        seen += [tuple(r) for r in page.collect()]
        ends.append(tuple(last))
    assert sorted(seen) == [(a, b) for a in range(5) for b in range(5)] and len(seen) == 25
    assert ends == [(1, 1), (2, 3), (4, 0), (4, 4)]
    assert snapshot.resume(df, ["a", "b"], (4, 2)).count() == 3 and snapshot.resume(df, ["a", "b"], None).count() == 25
    names = spark.createDataFrame([("b",), ("A",), ("a",), ("C",)], "s string")
    assert [r.s.lower() for r in snapshot.page_after(names, ["s"], ["A"], 9, "UTF8_LCASE").collect()] == ["b", "c"]


def test_older_settings():
    c = {"name": "p", "input": {"mysql": {"mode": "replication", "x": 1}}, "filters": [{"type": "reject", "match-table": "a"}], "output": {"stdout": {"routes": []}}, "scheduler": {"batch": {}}}
    p = Pipeline.of(c)
    assert p.input == {"type": "mysql", "mode": "replication", "x": 1}
    assert p.filters == [{"type": "reject", "config": {"match-table": "a"}}] and p.output == {"sink": "stdout", "routes": []}
    assert Pipeline.of({"name": "p", "input": {"kafka": {}}}).input["mode"] == "stream"


def test_config_hash():
    # 32-bit FNV-1a of "" and "a": 2166136261 and 3826002220
    letters = "bcdfghjklmnpqrstvwxz2456789"
    for text, n in (("", 2166136261), ("a", 3826002220)):
        assert config_hash(text) == "".join(letters[ord(c) % 27] for c in str(n))


def test_options():
    s = {"n": 3.0, "f": 2, "l": "x", "b": True, "bad": "7"}
    assert (option(s, "n", int), option(s, "f", float), option(s, "l", list), option(s, "b", bool), option(s, "none", int, 5)) == (3, 2.0, ["x"], True, 5)
    for name, kind in (("bad", int), ("b", int), ("n", str)):
        with pytest.raises(ValueError, match=name):
            option(s, name, kind)


def test_gtid():
    assert gtid.text(gtid.parse("B:5:1-3:4, a:7")) == "a:7,b:1-5"
    assert gtid.repaired("a:1-9,x:1-5", "a:1-20,b:1-7,m:1-3", "M") == "a:1-9,b:1-7"
    assert gtid.repaired("a:1-9,b:2", "a:1-20,b:1-7", "b") == "a:1-9,b:2"
    assert gtid.repaired("", "m:1-3", "m") == ""


def test_annotation():
    assert annotated("select 1", "by p") == "/*by p*/select 1"
    assert annotated("select 1", "x*/ drop table t; /*").count("*/") == 1


def test_barriers(spark):
    b = verify.barriers(spark, 3, 6, datetime(2023, 3, 1), 2.0).collect()
    assert [r.offset for r in b] == [3, 4, 5, 6] and (b[3].ts - b[0].ts).total_seconds() == 6
    m = spark.createDataFrame([("a", 1, None), ("a", 2, 1), ("a", 3, None), ("a", 4, 3), ("b", 1, 7), ("b", 2, 8)], "tag string, seq bigint, barrier bigint")
    assert sorted(map(tuple, verify.barrier_errors(m, "tag", "seq", "barrier").collect())) == [("a", 1, "no first barrier"), ("a", 4, "jump")]


def test_document_routes(spark):
    df = spark.createDataFrame([("d", "t", "insert"), ("d", "u", "delete"), ("d", "v", "insert")], "db string, tbl string, op string")
    routes = [{"match-table": "t", "target-index": "i"}, {"match-table": "u", "ignore-no-primary-key": True, "target-type": "x"}]
    assert sorted((r.tbl, r["index"], r.doc_type, r.ignore_without_key) for r in routing.route_documents(df, routes, F.col("tbl")).collect()) == [("t", "i", "doc", False), ("u", "u", "x", True)]
    assert routing.route_documents(df, [], F.col("tbl")).count() == 0
    keyless = routing.route_topics(df.withColumn("h", F.lit(None).cast("int")), [{"match-table": "*", "dml-topic": "x"}], F.col("h"), 4).collect()
    assert len(keyless) == 3 and all(0 <= r.partition < 4 for r in keyless)


def test_merged_fields(spark):
    rows = [(1, "insert", 1, {"a": "1", "b": "2"}), (1, "update", 2, {"b": "3", "c": None}), (2, "insert", 1, {"a": "x"}), (2, "delete", 5, None), (3, "update", 4, {"z": "9"}), (4, "insert", 1, {"a": "1"}), (4, "insert", 6, {"b": "7"}), (None, "insert", 1, {})]
    df = spark.createDataFrame(rows, "k int, op string, seq bigint, data map<string,string>")
    assert {r.k: r.data for r in documents.merged_fields(df, ["k"], "seq").collect()} == {1: {"a": "1", "b": "3", "c": None}, 3: {"z": "9"}, 4: {"b": "7"}, None: {}}


def test_log_positions(spark):
    df = spark.createDataFrame([("a", 5, "b", 1), ("b", 1, "a", 9), ("a", 5, "a", 7), ("a", 5, "a", 9), (None, 1, "a", 1)], "n string, p bigint, m string, q bigint")
    assert [r.c for r in df.select(scalar.compare_positions(F.col("n"), F.col("p"), F.col("m"), F.col("q"), 2).alias("c")).collect()] == [-1, 1, 0, -1, None]


def test_key_update_rows(spark):
    df = spark.createDataFrame([(1, "update", 5, "new", 4, "old"), (2, "update", 5, "n", 5, "o"), (3, "insert", 6, "i", None, None)], "seq int, op string, pk int, v string, opk int, ov string")
    got = changes.split_key_updates(df, {"pk": F.col("opk"), "v": F.col("ov")}, ["pk"]).orderBy("seq", "sub").collect()
    assert [(r.seq, r.sub, r.op, r.pk, r.v) for r in got] == [(1, 0, "delete", 4, "old"), (1, 1, "insert", 5, "new"), (2, 0, "update", 5, "n"), (3, 0, "insert", 6, "i")]


def test_repeated_statements_chain(spark):
    """Each is compared with the last one kept, not the last one seen."""
    rows = [("t", datetime(2023, 3, 1, 0, 0, s)) for s in (0, 20, 40, 59)] + [("u", None), ("u", None)]
    df = spark.createDataFrame(rows, "tbl string, ts timestamp")
    kept = streaming.drop_repeated_ddl(df, "tbl", "ts").collect()
    assert sorted(r.ts.second for r in kept if r.tbl == "t") == [0, 40] and sum(r.tbl == "u" for r in kept) == 2
