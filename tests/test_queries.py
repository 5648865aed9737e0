import pytest

from agora.plans import clients, documents, records, searches, shaped, texts  # noqa: F401


@pytest.mark.parametrize("name", sorted(records.SQL))
def test_query_equals_sql(name, same):
    same(records.QUERIES[name], records.SQL[name])


@pytest.mark.parametrize("name", sorted(set(records.QUERIES) - set(records.SQL)))
def test_query_without_sql_runs(name, spark, data):
    assert records.QUERIES[name](spark, data).count() > 0
