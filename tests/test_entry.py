import __spark_entry__ as entry


def test_every_sql_has_a_query_and_entry_runs(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    assert {"p3_found", "p6_found"} <= set(queries)


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0
