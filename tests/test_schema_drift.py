import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from driftline.functions.ddl import actions
from driftline.operators.schema_drift import consistent_rows, failed_casts, row_casts, schema_changes

SCHEMA = "rec_no bigint, src_file string, msg_version string, stream_key string, seq_no bigint, msg_type string, db string, tbl string, event_ts timestamp_ntz, dml_op string, data_json string, ddl_sql string"
T0 = datetime(2023, 3, 1)


def test_statements():
    one = lambda sql: [(a.kind, a.field, a.new_name, a.type_word) for _, _, a in actions(sql)]
    assert one("ALTER TABLE `a`.`t` ADD COLUMN (x int(11) DEFAULT NULL COMMENT 'drop column y, (z'), DROP `w` ;") == [("add", "x", "", "int"), ("drop", "w", "", "")]
    assert one("/* r */ alter  table t change `A` `b` decimal(10,2) NOT NULL,\n modify column c varchar(3)") == [("change", "a", "b", "decimal"), ("modify", "c", "", "varchar")]
    assert one("alter table t add index `i`(`x`), add key k (x), alter column x set default null, auto_increment = 5, comment = 'x, drop column y'") == []
    assert one("RENAME TABLE a TO `b`, c.d to e.f") == [("rename_table", "", "b", ""), ("rename_table", "", "f", "")]
    assert one("alter table t rename as s.u") == one("alter table t rename to `u`") == one("alter table t rename u") == [("rename_table", "", "u", "")]
    assert one("alter table t rename column x to y, rename index i to j") == [("change", "x", "y", "")]
    create = actions("CREATE TABLE IF NOT EXISTS t (`key` int NOT NULL, b decimal(10,2), PRIMARY KEY (`key`), KEY k (b)) ENGINE=InnoDB")
    assert create[0][2].columns == (("key", "int"), ("b", "decimal"))
    assert one(None) == one("") == one("drop view v") == one("alter") == one("alter table t drop") == []


class Feed:
    def __init__(self, spark):
        self.spark, self.rows, self.n = spark, [], 0

    def add(self, kind, body, tbl="t", version="2.0.alpha", op="insert", file="f"):
        self.n += 1
        at = T0 + timedelta(minutes=self.n)
        dml = kind == "dml"
        self.rows.append((self.n, file, version, "s", self.n, kind, "d", tbl, at, op if dml else None, json.dumps(body) if dml and body is not None else None, None if dml else body))

    def changes(self):
        df = self.spark.createDataFrame(self.rows, SCHEMA)
        df = df.union(df.where("rec_no % 3 = 0")).withColumns({"root": F.lit("clash"), "kind": F.lit(1)}).repartition(5)
        one = sorted(tuple(r)[1:] for r in schema_changes(df).collect())
        # many statements take the other way
        assert sorted(tuple(r)[1:] for r in schema_changes(df, broadcast_events=-1).collect()) == one
        return one


def test_told_changes(spark):
    f = Feed(spark)
    f.add("ddl", "create table T (id int, a varchar(3), b int, c int, primary key (id))")
    f.add("dml", {"id": 1, "a": "x", "b": 1, "c": 2})
    f.add("ddl", "alter table t add d int, drop column c, modify a varchar(9), modify b varchar(9), drop column nothing, add column a int")
    f.add("dml", {"id": 1, "a": "x", "b": "1", "d": 5})
    f.add("ddl", "alter table t change d `E` int")
    f.add("dml", {"id": 1, "a": "x", "b": "1", "e": 5})
    f.add("ddl", "rename table t to u")
    f.add("dml", {"id": 1, "a": "x", "b": "1", "e": 5}, tbl="`U`")
    f.add("ddl", "alter table u drop e", tbl="u")
    f.add("dml", {"id": 1, "a": "x", "b": "2"}, tbl="u")
    assert f.changes() == [("t", "added", "d", ""), ("t", "removed", "c", ""), ("t", "renamed", "d", "e"), ("t", "retyped", "b", ""), ("t", "table_renamed", "", "u"), ("u", "removed", "e", "")]


def test_shown_changes(spark):
    f = Feed(spark)
    f.add("ddl", "create table t (id int, a varchar(3), b int, c int, g varchar(9))")
    for i in range(4):
        f.add("dml", {"id": i, "a": f"v{i}", "b": 10 + i, "c": 1, "g": "z"})
    f.add("dml", {"id": 0, "a": "v0", "b": None, "c": 1, "g": "z"})
    f.add("dml", {"id": 0}, op="delete")
    for i in range(1, 4):  # a goes, n comes with its values
        f.add("dml", {"id": i, "n": f"v{i}", "b": 10 + i, "c": 1, "g": "z"}, op="update", file="late")
    for i in range(1, 4):  # g goes, h comes with other values; b becomes text, c has a fraction
        f.add("dml", {"id": i, "n": f"v{i}", "b": str(i), "c": 1.0, "h": i}, op="update")
    f.add("dml", {"id": 1, "n": "v1", "b": "7", "c": "1.0", "h": "1"}, op="update", version="0.1")
    assert f.changes() == [("t", "added", "h", ""), ("t", "removed", "g", ""), ("t", "renamed", "a", "n"), ("t", "retyped", "b", ""), ("t", "retyped", "c", "")]


def test_statement_wins_over_data(spark):
    f = Feed(spark)
    f.add("ddl", "create table t (id int, a int)")
    f.add("dml", {"id": 1, "a": 1})
    f.add("ddl", "alter table t modify a varchar(5)")
    f.add("dml", {"id": 1, "a": 2})
    f.add("dml", {"id": 1, "a": "2"})
    assert f.changes() == [("t", "retyped", "a", "")]


def test_nulls_and_empty(spark):
    f = Feed(spark)
    f.add("ddl", None)
    f.add("ddl", "not sql at all ((")
    f.add("dml", None)
    f.add("dml", {"id": 1, "a": "x" * 300_000})
    assert f.changes() == []
    rows = [(1, "f", None, None, None, "dml", None, None, None, "insert", "{bad", None), (2, "f", None, "s", 1, "dml", "d", "t", T0, "insert", "{bad", None)]
    assert schema_changes(spark.createDataFrame(rows, SCHEMA)).collect() == []
    assert schema_changes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rows_and_casts(spark):
    f = Feed(spark)
    f.add("ddl", "create table t (id int, a int)")
    f.add("dml", {"id": 1, "a": 5})
    f.add("dml", {"id": 1, "a": "6"}, version="0.1")
    f.add("ddl", "alter table t change a b int")
    f.add("dml", {"id": 2, "b": 7})
    f.add("ddl", "rename table t to u")
    f.add("dml", {"id": 3, "b": "no number"}, tbl="u", version="0.1")
    f.add("dml", {"id": 3, "b": 8}, tbl="u")
    df = spark.createDataFrame(f.rows, SCHEMA)
    rows = consistent_rows(df).collect()
    assert sorted((r.tbl, r.id, r.field, r.value) for r in rows if r.field != "id") == [("u", "1", "b", "5"), ("u", "1", "b", "6"), ("u", "2", "b", "7"), ("u", "3", "b", "8"), ("u", "3", "b", "no number")]
    assert [(r.n, r.failed) for r in failed_casts(df).where("tbl = 'u' and field = 'b'").collect()] == [(2, 1)]


def test_rows_of_a_name_used_twice(spark):
    """A name given up and given again names two fields."""
    f = Feed(spark)
    f.add("ddl", "create table t (id int, a int)")
    f.add("dml", {"id": 1, "a": 5})
    f.add("ddl", "alter table t change a b int")
    f.add("dml", {"id": 2, "b": 6})
    f.add("ddl", "alter table t add a varchar(9)")
    f.add("dml", {"id": 2, "b": 7, "a": "new"})
    f.add("ddl", "alter table t change a c varchar(9)")
    f.add("ddl", "alter table t change b a int")
    f.add("dml", {"id": 3, "a": 8, "c": "x"})
    rows = consistent_rows(spark.createDataFrame(f.rows, SCHEMA)).collect()
    assert sorted((r.id, r.field, r.value) for r in rows if r.field != "id") == [("1", "a", "5"), ("2", "a", "6"), ("2", "a", "7"), ("2", "c", "new"), ("3", "a", "8"), ("3", "c", "x")]


def silent(f, before, after, values):
    for i, v in enumerate(values):
        f.add("dml", {"id": i, **{n: v for n in before}})
    for i, v in enumerate(values):
        f.add("dml", {"id": i, **{n: v for n in after}}, op="update")


def test_silent_renames(spark):
    """Two fields of equal values renamed in one message, and one renamed twice."""
    f = Feed(spark)
    f.add("ddl", "create table t (id int, a int, b int)")
    silent(f, ["a", "b"], ["x", "y"], [1, 2, 3])
    for i, v in enumerate([1, 2, 3]):
        f.add("dml", {"id": i, "x": v, "z": v}, op="update")
    assert f.changes() == [("t", "renamed", "a", "x"), ("t", "renamed", "b", "y"), ("t", "renamed", "y", "z")]
    rows = consistent_rows(spark.createDataFrame(f.rows, SCHEMA)).collect()
    assert {r.field for r in rows} == {"id", "x", "z"}


def test_epochs_by_list_and_by_merge(spark, monkeypatch):
    """Few statements are listed by name, many are merged with the rows: the same results."""
    from driftline.operators import schema_drift

    f = Feed(spark)
    f.add("ddl", "create table t (id int, a int)")
    for k in range(6):
        f.add("dml", {"id": k, f"a{k - 1}" if k else "a": k})
        f.add("ddl", f"alter table t change {f'a{k - 1}' if k else 'a'} a{k} int")
    f.add("ddl", "rename table t to u")
    f.add("dml", {"id": 3, "a5": 1}, tbl="u")
    df = spark.createDataFrame(f.rows, SCHEMA)
    listed = sorted(map(tuple, schema_changes(df).collect()))
    assert sorted(map(tuple, schema_changes(df, broadcast_events=0).collect())) == listed and len(listed) == 7
    monkeypatch.setattr(schema_drift, "LISTED_EVENTS", 2)
    assert sorted(map(tuple, schema_changes(df).collect())) == listed


def test_typed_rows(spark):
    """Repeats come once, values are cast to the kind of their newest field, misfits are told."""
    f = Feed(spark)
    f.add("ddl", "create table t (id int, a int, o json)")
    f.add("dml", {"id": 1, "a": 5, "o": {"x": 1}})
    f.add("dml", {"id": 2, "a": 6, "o": {"x": 2}})
    f.add("ddl", "alter table t change a b int")
    f.add("dml", {"id": 3, "b": 2.5, "o": [1]})
    f.add("dml", {"id": 4, "b": "7", "o": "none"}, version="0.1")
    df = spark.createDataFrame([*f.rows, (99, *f.rows[1][1:])], SCHEMA)
    rows = consistent_rows(df).collect()
    got = {(r.id, r.field): (r.kind, r.as_int, r.as_json, r.failed) for r in rows}
    assert len(rows) == len(got) == 12
    assert [got[str(i), "b"] for i in (1, 2, 3, 4)] == [("i", 5, None, False), ("i", 6, None, False), ("i", None, None, True), ("i", 7, None, False)]
    assert got["1", "o"] == ("o", None, '{"x":1}', False) and got["4", "o"] == ("o", None, None, True)
    assert {(r.field, r.n, r.failed) for r in row_casts(consistent_rows(df)).collect()} == {("id", 4, 0), ("b", 4, 1), ("o", 4, 1)}


def test_casts_of_each_kind(spark):
    f = Feed(spark)
    for _ in range(2):
        f.add("dml", {"id": 1, "i": 5, "f": 1.5, "b": True, "o": {"x": 1}, "t": "x"})
    f.add("dml", {"id": 2, "i": 2.5, "f": "1e3", "b": "maybe", "o": 7, "t": 3})
    f.add("dml", {"id": "18446744073709551615", "i": "6", "f": "x", "b": "false", "o": "[1]", "t": None}, version="0.1")
    got = {r.field: (r.kind, r.n, r.failed) for r in failed_casts(spark.createDataFrame(f.rows, SCHEMA)).collect()}
    assert got == {"id": ("i", 4, 0), "i": ("i", 4, 1), "f": ("f", 4, 1), "b": ("b", 4, 1), "o": ("o", 4, 1), "t": ("t", 3, 0)}
