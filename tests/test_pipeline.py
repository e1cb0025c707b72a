"""Matchers, filters, routes, order, verification, documents and streams."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from driftline.config import Pipeline
from driftline.streaming.tables import KeyedTable
from driftline.functions import scalar
from driftline.functions.glob import glob, glob_matches
from driftline.operators import changes, documents, encode, filters, predicates, routing, snapshot, verify
from driftline.streaming import changes as streaming


def test_glob(spark):
    cases = [("", "", True), ("", "a", False), ("*", "", True), ("a*c", "abbc", True), ("a*c", "abcd", False), ("a.c", "abc", False), ("*b*", "abc", True), ("A*", "abc", False), ("a*", "a\nb", True), ("a", "a\n", False), ("[x]*", "[x]y", True)]
    df = spark.createDataFrame(cases, "p string, t string, want boolean")
    for p, t, want in cases:
        assert glob_matches(t, p) == want
        assert df.where((F.col("p") == p) & (F.col("t") == t)).select(glob(F.col("t"), p)).first()[0] == want


def test_matchers(spark):
    df = spark.createDataFrame([("dml", "d1", "t_1", "insert", None), ("ddl", "d1", "t_2", None, "alter table x"), ("dml", "d2", None, "delete", None)], "msg_type string, db string, tbl string, op string, ddl string")
    n = lambda c: df.where(predicates.matcher(c)).count()
    assert n({}) == 3
    assert n({"match-schema": "d*", "match-table": ["t_1", "t_2"]}) == 2
    assert n({"match-table-regex": "_[12]$"}) == 2
    assert n({"match-dml-op": ["insert", "delete"]}) == 2
    assert n({"match-ddl-regex": "^alter"}) == 1
    for bad in ({"match-dml-op": "upsert"}, {"match-nothing": 1}):
        with pytest.raises(ValueError):
            predicates.matcher(bad)


def maps(spark):
    rows = [("dml", "t", {"a": "1", "b": "2", "e": "3", "f": "4"}, {"a": "100", "b": "101", "e": "102", "f": "103"}, {"a": "1"}), ("dml", "u", {"a": "1"}, None, {"a": "1"}), ("ctl", None, None, None, None)]
    return spark.createDataFrame(rows, "msg_type string, tbl string, data map<string,string>, old map<string,string>, pks map<string,string>")


def test_rename_columns(spark):
    out = filters.chain(maps(spark), [{"type": "rename-dml-column", "config": {"match-table": "t", "from": ["a", "b"], "to": ["c", "d"]}}])
    t, u, ctl = sorted(out.collect(), key=lambda r: (r.tbl is None, r.tbl))
    assert t.data == {"c": "1", "d": "2", "e": "3", "f": "4"} and t.old == {"c": "100", "d": "101", "e": "102", "f": "103"} and t.pks == {"c": "1"}
    assert u.data == {"a": "1"} and ctl.msg_type == "ctl"


def test_rename_absent_and_delete(spark):
    out = filters.chain(maps(spark), [{"type": "rename-dml-column", "config": {"match-table": "u", "from": ["x"], "to": ["a"]}}, {"type": "delete-dml-column", "config": {"match-table": "t", "columns": ["a", "f"]}}])
    rows = {r.tbl: r for r in out.collect()}
    assert rows["u"].data == {"a": None} and rows["u"].pks == {"a": "1"}
    assert rows["t"].data == {"b": "2", "e": "3"} and rows["t"].pks == {}


def test_chain_checks(spark):
    for bad in ([{"type": "accept", "config": {}}], [{"type": "nope", "config": {"match-table": "*"}}]):
        with pytest.raises(ValueError):
            filters.chain(maps(spark), bad)


def test_reject_keeps_unknown(spark):
    df = spark.createDataFrame([("a",), (None,)], "tbl string")
    assert [r.tbl for r in filters.reject(df, predicates.match_table("a")).collect()] == [None]


def test_routes(spark):
    df = spark.createDataFrame([("d", "a", 1), ("d", "b", -2), ("d", "c", None)], "db string, tbl string, k int")
    routed = routing.route_tables(df, [{"match-table": "a", "target-table": "z"}, {"match-table": ["a", "b"], "target-schema": "e"}])
    assert sorted((r.tgt_db, r.tgt_tbl) for r in routed.collect()) == [("d", "z"), ("e", "b")]
    assert routing.route_tables(df, []).count() == 3
    assert routing.route_topics(df, [], F.col("k"), 3).count() == 0
    assert sorted((r.topic, r.partition) for r in routing.route_topics(df, [{"match-table": "b", "dml-topic": "x"}], F.col("k"), 3).collect()) == [("x", 1)]
    models = routing.route_models(df, [{"name": "m", "match-table": "a"}, {"name": "m", "match-table": "*"}, {"name": "n", "match-table": "c"}])
    assert sorted((r.tbl, r.model) for r in models.collect()) == [("a", "m"), ("b", "m"), ("c", "m"), ("c", "n")]


def test_dependency_keys(spark):
    cases = [((1, 1, None, None), 1), ((1, 1, 5, 5), 2), ((1, 1, 5, 6), 3), ((1, 2, 5, 6), 4), ((1, 1, None, 6), 2), ((1, 1, 5, None), 2)]
    df = spark.createDataFrame([c[0] for c in cases], "pk int, old_pk int, uk int, old_uk int")
    keys = changes.dependency_keys(F.lit("d"), F.lit("t"), {"PRIMARY": [(F.col("pk"), F.col("old_pk"))], "uk": [(F.col("uk"), F.col("old_uk"))]})
    assert [r.n for r in df.coalesce(1).select(F.size(keys).alias("n")).collect()] == [c[1] for c in cases]


def test_fail_on_tag(spark):
    df = spark.createDataFrame([("mine",)], "p string")
    assert changes.fail_on_tag(df, F.col("p"), F.col("p") == "other").count() == 1
    with pytest.raises(Exception, match="transaction of pipeline mine"):
        changes.fail_on_tag(df, F.col("p"), F.col("p") == "mine").collect()


KEYS = [(a, b, c) for a in (1, 2) for b in (1, 2, 3) for c in (1, 2)]


def test_keyset_pages(spark):
    df = spark.createDataFrame(KEYS, "a int, b int, c int").repartition(3)
    seen, last = [], None
    while True:
        page = [tuple(r) for r in snapshot.page_after(df, ["a", "b", "c"], last, 5).collect()]
        if not page:
            break
        seen, last = seen + page, page[-1]
    assert seen == sorted(KEYS)
    assert tuple(snapshot.key_bounds(df, ["a", "b", "c"]).first()) == (1, 1, 1, 2, 3, 2)
    plan = snapshot.page_after(df, ["a", "b", "c"], (1, 2, 1), 5)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan


def test_scan_columns_and_discovery():
    assert snapshot.scan_columns(["a", "b"], [], 10, 5) == ["a", "b"]
    assert snapshot.scan_columns([], [["x", "y"], ["z"]], 10, 5) == ["z"]
    assert snapshot.scan_columns([], [["x", "y"]], 4, 5) == []
    with pytest.raises(ValueError):
        snapshot.scan_columns([], [["x", "y"]], 10, 5)
    assert snapshot.discover([("d", "a1"), ("d", "a2"), ("e", "a1")], "d", ["a*"], ["*2"]) == [("d", "a1")]


def test_documents(spark):
    main = spark.createDataFrame([(1, "x"), (2, "y")], "id int, name string")
    kids = spark.createDataFrame([(1, 3, "c"), (1, 1, "a"), (1, 2, None), (9, 1, "z")], "id int, n int, v string")
    out = {r.id: [tuple(k) for k in r.kids] for r in documents.attach_many(main, kids, ["id"], "kids", [("v", "v")], ["n"]).collect()}
    assert out == {1: [("a",), (None,), ("c",)], 2: []}
    assert documents.pick_columns(["a", "b", "c"], include=["a", "c"], exclude=["c"], convert={}, prefix="p_") == [("a", "p_a")]


def test_encode(spark):
    df = spark.createDataFrame([("d", "t", "insert", datetime(2023, 3, 1, 0, 0, 1, 500000), 1, None)], "db string, tbl string, op string, ts timestamp, a int, b string")
    v01 = json.loads(df.select(encode.json_v01(F.col("db"), F.col("tbl"), F.col("op"), F.col("ts"), encode.text_map(["a", "b"]))).first()[0])
    assert v01["data"] == {"a": "1", "b": None} and v01["time_zone"] == "Asia/Shanghai" and v01["ts"] == 1677628801
    v20 = json.loads(df.select(encode.json_v20(F.col("db"), F.col("tbl"), F.col("op"), scalar.rfc3339(F.col("ts")), F.struct("a", "b"))).first()[0])
    assert v20["Data"] == {"a": 1, "b": None} and v20["ts"] == "2023-03-01T00:00:01.5Z"
    rows = df.select(F.lit("x").alias("topic"), F.lit(0).alias("partition"), "a", "op")
    assert encode.kafka_rows(rows, F.col("a"), F.col("op"), limit=20, skip_large=True).count() == 0
    with pytest.raises(Exception, match="too large"):
        encode.kafka_rows(rows, F.col("a"), F.col("op"), limit=20).collect()


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.unsigned(F.lit(-1).cast("bigint"), 64).cast("string"),
        scalar.unsigned(F.lit(-1), 24).cast("string"),
        scalar.capitalise(F.lit("élan")),
        scalar.capitalise(F.lit("aBC")),
        scalar.oplog_seconds(F.lit(5 << 32 | 7)),
        scalar.tso_seconds(F.lit(3500 << 18)),
        scalar.key_signature(F.lit("d"), F.lit("t"), F.lit(1), F.lit("x")),
        scalar.table_identity(F.lit("d"), F.lit("t")),
    ).first()
    assert tuple(row) == ("18446744073709551615", "16777215", "élan", "ABC", 5, 3, "d`.`t:1_x_", "`d`.`t`")


def test_segments(spark):
    schema = "seg bigint, payload_id string, ts bigint, id string, checksum string"
    a = [(1, "p", 1, "i1", "x"), (1, "p", 2, "i2", "y"), (2, "p", 1, "i3", "x"), (3, "p", 1, "i4", "x")]
    b = [(1, "p", 2, "i2", "y"), (1, "p", 1, "i1", "x"), (2, "p", 1, "i3", "z")]
    got = {r.seg: r.verdict for r in verify.compare_segments(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    assert got == {1: "same", 2: "diff", 3: "timeout"}


def test_checksums(spark):
    one = spark.createDataFrame([(1, None), (2, "a")], "a int, b string")
    same = lambda x, y: verify.table_checksum(x, ["a", "b"]).first() == verify.table_checksum(y, ["a", "b"]).first()
    assert same(one, one.orderBy(F.desc("a")))
    assert not same(one, spark.createDataFrame([(1, ""), (2, "a")], "a int, b string"))
    assert verify.table_checksum(one.where("false"), ["a"]).first()[0] == 0


def test_pipeline_config(spark, tmp_path):
    conf = {"name": "p", "filters": [{"type": "reject", "config": {"match-dml-op": "delete"}}], "output": {"routes": [{"match-table": "t*", "target-table": "all"}], "engine": "insert-ignore"}}
    path = tmp_path / "p.json"
    path.write_text(json.dumps(conf))
    p = Pipeline.load(str(path))
    df = spark.createDataFrame([("d", "t1", 1, "insert", 1, 5), ("d", "t2", 1, "update", 2, 6), ("d", "t1", 1, "delete", 3, 7), ("d", "x", 2, "insert", 4, 8)], "db string, tbl string, pk int, op string, seq bigint, v int")
    assert [tuple(r) for r in p.fold(df, ["pk"], "seq", ["v"]).collect()] == [("d", "all", 1, 5, 1)]
    assert p.hash() == Pipeline.load(str(path)).hash()
    for bad in ({}, {"name": "x", "more": 1}):
        with pytest.raises(ValueError):
            Pipeline.of(bad)


def test_stream_equals_batch(spark, tmp_path):
    schema = "pk int, v int, op string, seq bigint"
    files = [[(1, 1, "insert", 1), (2, 1, "insert", 2)], [(1, 2, "update", 5), (2, 0, "delete", 4)], [(2, 9, "update", 3), (3, 1, "insert", 6)]]
    src = str(tmp_path / "in")
    target = KeyedTable(spark, str(tmp_path / "target"), ["pk"], 8)
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(schema).parquet(src)
        q = streaming.run_to_end(stream, str(tmp_path / "check"), streaming.apply_batches(target, "seq", ["v"]))
    assert sorted((r.pk, r.v, r.seq) for r in streaming.live_rows(target).collect()) == [(1, 2, 5), (3, 1, 6)]
    assert streaming.status(q, "p")["stage"] == "ended"
    # a batch that is run again writes the same version
    streaming.apply_batches(target, "seq", ["v"])(spark.createDataFrame(files[2], schema), target.current())
    assert sorted((r.pk, r.v) for r in streaming.live_rows(target).collect()) == [(1, 2), (3, 1)]


def test_repeated_statements(spark):
    rows = [("t", datetime(2023, 3, 1, 0, 0, 0)), ("t", datetime(2023, 3, 1, 0, 0, 20)), ("t", datetime(2023, 3, 1, 0, 5, 0)), ("u", datetime(2023, 3, 1, 0, 0, 1))]
    df = spark.createDataFrame(rows, "tbl string, ts timestamp")
    assert streaming.drop_repeated_ddl(df, "tbl", "ts").count() == 3


def test_mysql_types():
    from driftline.functions.mysql_types import declaration, spark_type

    assert declaration("BIGINT(20) unsigned") == ("bigint", (20,), True) and declaration("enum('1','2')") == ("enum", (), False)
    types = {"decimal(11,3)": "decimal(11,3)", "decimal": "decimal(10,0)", "bigint unsigned": "decimal(20,0)", "int unsigned": "bigint", "tinyint(4)": "tinyint", "int(11)": "int", "double": "double", "float(11,3)": "float", "datetime(6)": "timestamp_ntz", "time": "string", "text": "string", "enum('a')": "string", "date": "date", "bit(1)": "bigint", "json": "string", "mediumint(8) unsigned": "int", "smallint unsigned": "int", "year(4)": "int", "varchar(9)": "string", "double(25,3)": "double", "timestamp": "timestamp", "tinyblob": "binary", "": "string"}
    assert {t: spark_type(t) for t in types} == types


def test_retarget():
    from driftline.functions.retarget import retarget

    to = lambda db, t: None if t == "skip" else ("x", t)
    run = lambda s: retarget(s, "d", to)
    assert run("create table a.t (id int(11) default '1,2', primary key (`id`)) engine=InnoDB;") == ["CREATE TABLE IF NOT EXISTS `x`.`t` (id int(11) default '1,2', primary key(`id`)) engine = InnoDB"]
    assert run("CREATE TABLE t LIKE u") == ["CREATE TABLE IF NOT EXISTS `x`.`t` LIKE `x`.`u`"]
    assert run("drop table if exists t, skip, e.v") == ["DROP TABLE IF EXISTS `x`.`t`", "DROP TABLE IF EXISTS `x`.`v`"]
    assert run("alter table t add column c int") == ["ALTER TABLE `x`.`t` add column c int"]
    assert run("rename table t to v, skip to w") == ["RENAME TABLE `x`.`t` TO `x`.`v`"]
    assert run("create database if not exists d") == ["CREATE DATABASE IF NOT EXISTS `x`"]
    assert run("truncate table t") == run("create index i on t (a)") == run("") == run("alter table skip drop a") == []


def test_run_pipeline(spark, tmp_path):
    from driftline.__main__ import run
    from driftline.sources.feeds import ENVELOPE

    rows = [("s", 1, "dml", "d", "t", None, "insert", {"a": "1"}, None, {"a": "1"}, 1), ("s", 2, "dml", "d", "u", None, "insert", {"a": None}, None, None, 1), ("s", 3, "ctl", None, None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, ENVELOPE).write.parquet(str(tmp_path / "in"))
    for mode in ("batch", "stream"):
        out = str(tmp_path / mode)
        p = Pipeline.of({"name": "p", "input": {"format": "parquet", "path": str(tmp_path / "in"), "mode": mode, "checkpoint": str(tmp_path / "c")}, "filters": [{"type": "reject", "config": {"match-table": "u"}}], "output": {"sink": "parquet", "options": {"path": out}, "routes": [{"match-table": "*", "target-table": "all"}]}})
        assert run(spark, p)["stage"] == "ended"
        assert [(r.tbl, r.tgt_tbl, r.data) for r in spark.read.parquet(out).collect()] == [("t", "all", {"a": "1"})]


def test_document_sink_needs_keys(spark):
    from driftline.sources.sinks import documents as index

    df = spark.createDataFrame([("-T", 1, "insert", 1, "x"), ("-T", None, "insert", 2, "y")], "tbl string, pk int, op string, seq bigint, v string")
    assert [tuple(r) for r in index(df, ["pk"], "seq", ["v"], ignore_without_key=True).collect()] == [("t", "1", '{"pk":1,"v":"x"}')]
    with pytest.raises(Exception, match="without primary key"):
        index(df, ["pk"], "seq", ["v"]).collect()


def test_positions(spark, tmp_path):
    from driftline.streaming.positions import Position, PositionStore, pending_tables, retry

    store = PositionStore(spark, str(tmp_path / "p"))
    assert store.get("a", start=5) == Position("a", start=5, value=5)
    for i in range(8):
        store.put(Position("a", stage="stream", start=5, value={"seq": i}, done=["t"]))
    p = store.get("a", start=5)
    assert (p.stage, p.value, pending_tables(["t", "u"], p)) == ("stream", {"seq": 7}, ["u"])
    assert store.get("a", start=6).value == 6
    store.reset("a")
    assert store.get("a").value is None
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert retry(flaky, wait_s=0) == "ok" and len(calls) == 3
    with pytest.raises(OSError):
        retry(lambda: (_ for _ in ()).throw(OSError()), times=1, wait_s=0)


def test_snapshot_planning(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    assert snapshot.sampled_bounds(df, "k", 4) == []
    bounds = snapshot.sampled_bounds(df, "k", 4, threshold=100)
    assert len(bounds) == 3 and all(abs(b - 5000 * (i + 1)) < 1200 for i, b in enumerate(bounds))
    assert snapshot.table_message("t", df, ["k"]) == "CREATE TABLE IF NOT EXISTS `t` (`k` bigint, PRIMARY KEY (`k`))"
    assert snapshot.is_empty(df, "k < 0") and not snapshot.is_empty(df)
    parts = snapshot.ranged_scan(df, ["k"], 4).select(F.spark_partition_id().alias("p"), "k").groupBy("p").agg(F.min("k").alias("a"), F.max("k").alias("b")).orderBy("a").collect()
    assert all(x.b < y.a for x, y in zip(parts, parts[1:]))


def test_index_mapping(spark):
    df = spark.createDataFrame([], "id bigint, o struct<a:string>, many array<struct<n:int>>, tags array<string>, d decimal(9,2)")
    assert documents.index_mapping(df.schema)["properties"] == {
        "id": {"type": "long"},
        "o": {"type": "object", "properties": {"a": {"type": "keyword"}}},
        "many": {"type": "nested", "properties": {"n": {"type": "integer"}}},
        "tags": {"type": "keyword"},
        "d": {"type": "keyword"},
    }


def test_oplog(spark):
    from driftline.operators import oplog

    rows = [(1, "x1", "i", "d.c.sub", '{"_id":"x1"}'), (2, "x2", "u", "d.c", '{"$set":{}}'), (3, None, "c", "d.$cmd", '{"drop":"t"}'), (4, None, "c", "d.$cmd", '{"create":"t"}'), (5, "x", "i", None, "{}"), (6, "x", "?", "d.c", None), (7, None, "d", "d.c", '{"_id":{"$oid":"x9"}}')]
    df = spark.createDataFrame(rows, "op_no bigint, obj_id string, operation string, op_ns string, data_json string")
    got = sorted((r.op_no, r.op, r.db, r.coll, r.id) for r in oplog.parse(df).collect())
    assert got == [(1, "insert", "d", "c.sub", "x1"), (2, "update", "d", "c", "x2"), (3, "drop", "d", "t", None), (7, "delete", "d", "c", "x9")]
    spread = oplog.spread(oplog.parse(df), "document", 3, "op_no")
    assert spread.count() == 4
    with pytest.raises(ValueError):
        oplog.ordering_key("other", F.col("db"), F.col("coll"), F.col("id"))


@pytest.mark.parametrize("engine", [None, "replace", "insert-ignore"])
def test_stream_keeps_earlier_batches(spark, tmp_path, engine):
    """Newly arrived files under the same checkpoint add to what is there, or fold into it by the engine."""
    from driftline.__main__ import run
    from driftline.sources.feeds import ENVELOPE

    def change(seq, op, id_, a):
        return ("s", seq, "dml", "d", "t", None, op, {"a": a}, None, {"id": id_}, 1)

    output = {"sink": "parquet", "options": {"path": str(tmp_path / "out")}}
    if engine:
        output |= {"engine": engine, "keys": ["id"], "order": "seq", "columns": ["a"]}
    p = Pipeline.of({"name": "p", "input": {"format": "parquet", "path": str(tmp_path / "in"), "mode": "stream", "checkpoint": str(tmp_path / "c")}, "output": output})
    batches = [[change(1, "insert", "1", "x"), change(2, "insert", "2", "y"), change(6, "update", "2", "z")], [change(7, "update", "1", "v"), change(4, "delete", "2", None)]]
    for rows in batches:
        spark.createDataFrame(rows, ENVELOPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        run(spark, p)
    if engine is None:
        assert sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2, 4, 6, 7]
        return
    rows = KeyedTable(spark, str(tmp_path / "out/rows"), ["tgt_db", "tgt_tbl", "id"]).read().collect()
    assert {(r.id, r.a) for r in rows} == {("1", "v" if engine == "replace" else "x"), ("2", "z")}


def test_mongo_documents(spark, tmp_path):
    """Whole documents with quotes, backslashes and line feeds come back as they were."""
    from driftline.plans.catalogue import encode_mongo

    texts = ['{"a": "x\\"y\\\\z\\n", "b": [{"c": "é/\U0001f600"}]}', '{"long": "' + "w" * 100_000 + '"}', "line\nfeed\ttab", "", None]
    rows = [(i, "u", "d.c", t, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "op_no bigint, operation string, op_ns string, data_json string, row_json string").write.parquet(str(tmp_path / "oplog_ops.parquet"))
    got = {r.op_no: json.loads(r.json) for r in encode_mongo(spark, str(tmp_path)).collect()}
    documents = [json.loads(texts[0]), json.loads(texts[1]), *texts[2:]]
    assert got == {i: {"version": "2.0.alpha", "database": "d", "collection": "c", "data": t, "row": t} for i, t in enumerate(documents)}
