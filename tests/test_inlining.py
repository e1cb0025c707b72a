import json

from pyspark.sql import functions as F

from driftline.operators import inlining

DOCS = [
    (1, {"name": "a", "home": {"city": "x", "geo": {"lat": 1}}, "kids": [{"n": 1, "toys": [{"t": "p"}, None, {"t": "q"}]}, None, {"n": 2, "toys": {"t": "r"}}]}),
    (2, {"name": "b", "kids": {"n": 3}, "home": json.dumps({"city": "y"})}),
    (3, {"name": "c", "kids": json.dumps([{"n": 4, "toys": json.dumps([{"t": "s"}])}, 5, "z"])}),
    (4, {"name": "d", "kids": [], "tags": [1, 2]}),
]


def frame(spark, docs):
    rows = [(i, None if x is None else x if isinstance(x, str) else json.dumps(x)) for i, x in docs]
    return spark.createDataFrame(rows, "id bigint, doc string").withColumns({"path": F.lit("clash"), "index": F.lit(1)})


def test_children(spark):
    df = frame(spark, DOCS)
    graph = inlining.schema_graph(df, F.col("doc"))
    assert graph.why == {"kids": "repeated", "kids.toys": "repeated"}
    got = sorted((r.id, r.path, r["index"], r.parent_index) for r in inlining.child_rows(df, ["id"], F.col("doc"), graph).collect())
    assert got == [
        (1, "kids", "0", ""),
        (1, "kids", "2", ""),
        (1, "kids.toys", "0.0", "0"),
        (1, "kids.toys", "0.2", "0"),
        (1, "kids.toys", "2.0", "2"),
        (2, "kids", "0", ""),
        (3, "kids", "0", ""),
        (3, "kids.toys", "0.0", "0"),
    ]


def test_tables(spark):
    tables = inlining.inline(frame(spark, DOCS), ["id"], F.col("doc"))
    assert set(tables) == {"", "kids", "kids.toys"}
    root = {r.id: (r.name, r.home_city, r.home_geo_lat, r.tags) for r in tables[""].collect()}
    assert root == {1: ("a", "x", 1, None), 2: ("b", "y", None, None), 3: ("c", None, None, None), 4: ("d", None, None, "[1,2]")}
    assert sorted((r.id, r["index"], r.t) for r in tables["kids.toys"].collect()) == [(1, "0.0", "p"), (1, "0.2", "q"), (1, "2.0", "r"), (3, "0.0", "s")]


def test_bad_documents(spark):
    df = frame(spark, [(1, None), (2, ""), (3, "{bad"), (4, "[1]"), (5, '"x"'), (6, {"id": 9, "index": 8, "kids": [{"x": "y" * 500_000}]})])
    graph = inlining.schema_graph(df, F.col("doc"))
    assert [(r.id, r.path) for r in inlining.child_rows(df, ["id"], F.col("doc"), graph).collect()] == [(6, "kids")]
    root = inlining.flat_table(df, ["id"], F.col("doc"), graph, "")
    assert [(r.id, r.id_) for r in root.collect() if r.id == 6] == [(6, 9)]
    empty = df.where("false")
    assert inlining.child_rows(empty, ["id"], F.col("doc"), inlining.schema_graph(empty, F.col("doc"))).collect() == []


def test_shared_and_recursive(spark):
    """One table for each element type, whichever paths lead to it."""
    docs = [
        (1, {"home": {"addr": {"zip": 1, "city": "x"}}, "work": {"addr": {"zip": 2, "city": "y"}}, "part": {"v": 1, "part": {"v": 2, "part": {"v": 3}}}}),
        (2, {"part": {"v": 4, "part": None}}),
    ]
    tables = inlining.inline(frame(spark, docs), ["id"], F.col("doc"))
    assert set(tables) == {"", "addr", "part"}
    assert sorted((r.id, r.parent_path, r.zip, r.city) for r in tables["addr"].collect()) == [(1, "", 1, "x"), (1, "", 2, "y")]
    assert sorted((r.id, r.path, r.parent_path, r.v) for r in tables["part"].collect()) == [(1, "part", "", 1), (1, "part.part", "part", 2), (1, "part.part.part", "part.part", 3), (2, "part", "", 4)]
    graph = inlining.schema_graph(frame(spark, docs), F.col("doc"))
    assert graph.why == {"addr": "shared", "part": "recursive"}


def test_names_of_any_characters(spark):
    docs = [(1, {"a.b": 1, "a": {"b": 2}, "it's": 3, "say \"x\" 'y'": {"z": 4}, "$k": [{"p.q": 5}]})]
    tables = inlining.inline(frame(spark, docs), ["id"], F.col("doc"))
    root = tables[""].collect()[0].asDict()
    assert sorted(v for k, v in root.items() if k != "id") == [1, 2, 3, 4]
    assert [r["p_q"] for r in tables["$k"].collect()] == [5]


def test_scalars_beside_objects(spark):
    docs = [(1, {"t": {"n": "a"}}), (2, {"t": "plain"}), (3, {"t": None}), (4, {"t": [1, 2]})]
    rows = {r.id: (r.t, r.t_n) for r in inlining.inline(frame(spark, docs), ["id"], F.col("doc"))[""].collect()}
    assert rows == {1: (None, "a"), 2: ("plain", None), 3: (None, None), 4: (None, None)}
