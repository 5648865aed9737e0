import __spark_entry__ as e


def test_entry(spark):
    rows = e.entry(spark).collect()
    assert rows and [r["score"] for r in rows] == sorted((r["score"] for r in rows), reverse=True)


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())
