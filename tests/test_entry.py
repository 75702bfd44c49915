import __spark_entry__ as entry


def test_names_and_sql_belong_together():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["domain_id", "year", "n", "mncs", "n25", "n10", "n1"] and df.count() > 0
