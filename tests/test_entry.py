import __spark_entry__ as entry


def test_contract(spark):
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    for n in (1, 2, 3, 4, 5, 6):
        assert f"p{n}_found" in q
    df = entry.entry(spark)
    assert df.columns == ["db", "tbl", "pk", "seq_no"]
    assert df.count() > 0
