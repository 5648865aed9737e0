import pytest
from pyspark.sql import functions as F

from agora.operators import counts, merge, order, search, vectors
from agora.plans import documents, records, searches, shaped  # noqa: F401  fill records.QUERIES


@pytest.mark.parametrize("name", ["o6_deep_page", "o6_last_page", "o9_matched_first"])
def test_deep_pages_and_positions_equal_sql(same, monkeypatch, name):
    monkeypatch.setattr(order, "SHALLOW", 0)
    same(records.QUERIES[name], records.SQL[name])


def test_every_page_is_found_by_ranges(spark, monkeypatch):
    df = spark.range(103).select("id", (F.col("id") % 7).alias("k"))
    by = [F.desc("k"), F.asc("id")]
    want = [(r.id, r.k) for r in df.orderBy(*by).collect()]
    monkeypatch.setattr(order, "SHALLOW", 0)
    got = [[(r.id, r.k) for r in order.page(df, by, n, 25).collect()] for n in (0, 1, 2, 3, 4, 5, 99)]
    assert got == [want[:25], want[:25], want[25:50], want[50:75], want[75:100], want[100:], want[100:]]
    assert order.page(df.limit(0), by, 3, 4).collect() == []
    assert sorted((r.position, r.id) for r in order.positions(df, by).collect()) == [(n, i) for n, (i, _) in enumerate(want, 1)]


def test_only_the_ranges_of_the_page_are_read(spark, monkeypatch):
    monkeypatch.setattr(order, "SHALLOW", 0)
    page = order.page(spark.range(4000), [F.asc("id")], 100, 10)
    assert [r.id for r in page.collect()] == list(range(990, 1000))
    read = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in read and "_range" in read


def test_first_votes_and_rewritten_documents(spark):
    calls = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (None, 1)], "congress int, roll int")
    cast = spark.createDataFrame([(1, 1, "m", "Nay", 2), (1, 1, "m", "Yea", 1), (1, 1, "x", "Yea", 0), (2, 1, "m", "Nay", 0), (None, 1, "m", "Nay", 0)], "congress int, roll int, member string, vote string, at int")
    got = merge.member_votes(calls, cast, ["congress", "roll"], F.col("member") == "m", [F.col("at")]).select("congress", "roll", "vote").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "Yea"), (2, 1, "Nay")]
    docs = spark.createDataFrame([("a", 1, "old", "b"), ("b", 2, "old", None)], "id string, n int, votes string, bills string")
    assert sorted(map(tuple, merge.rewritten(docs, spark.createDataFrame([("a", "new")], "id string, votes string"), "id").select("id", "n", "votes").collect())) == [("a", 1, "new"), ("b", 2, None)]


def test_files_and_last_metadata_of_an_index(spark):
    df = spark.createDataFrame([("k", "f1", 1, [1.0, 2.0], "one"), ("k", "f1", 2, None, "two"), ("k", "f2", 3, [], None), ("k", "f0", 4, [3.0, 4.0], " "), ("z", "f9", 5, None, "")], "key string, file string, at int, v array<double>, title string")
    got = {r.key: (r.total, r.dimension, [tuple(f) for f in r.files], r.title) for r in counts.embedding_index(df, "key", "v", "file", [F.col("at")], ["title"]).collect()}
    assert got == {"k": (2, 2, [("f1", 1), ("f2", 0), ("f0", 1)], "two"), "z": (0, None, [("f9", 0)], None)}


def test_stacked_blocks_and_members(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id int, embedding array<double>")
    assert [(r.block, r.vec_id) for r in vectors.stacked({"a": one, "b": one}).orderBy("block").collect()] == [("a", 1), ("b", 1)]
    with pytest.raises(ValueError):
        vectors.stacked({"a": one, "b": spark.createDataFrame([(2, [1.0])], one.schema)})
    with pytest.raises(ValueError):
        vectors.stacked({})
    members = spark.createDataFrame([(0, "Democratic", "NY", "health care"), (1, "Republican", "NY", "care"), (2, "Democratic", "CA", "care"), (3, "Independent", "NY", "zzzzzzz")], "position int, party string, state string, search_text string")
    ids = lambda *a: [r.position for r in search.search_members(members, *a).collect()]
    assert ids() == [0, 1, 2, 3] and ids("care") == [0, 1, 2] and ids("care", "Democrat") == [0, 2] and ids("", "Third party") == [3] and ids("care", "all", "CA") == [2]
