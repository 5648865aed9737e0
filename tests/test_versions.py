import pytest
from pyspark.sql import functions as F

from agora.plans import documents, records  # noqa: F401  fills records.QUERIES
from agora.sources import sinks, versions
from agora.streaming import incremental

SHAPE = "id string, key string, embedding array<float>, model string, payload string"


def rows(spark, ids, model):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in ids], "i int, e array<double>").repartition(3)
    return sinks.vector_rows(df, ["i"], "e", model, F.struct("i"))


def stored(spark, path, at=None):
    return sorted((r.key, r.model) for r in versions.read(spark, path, SHAPE, at).collect())


def test_query_equals_sql(same):
    same(records.QUERIES["snk5_committed_upsert"], records.SQL["snk5_committed_upsert"])


def test_versions_and_clearing(spark, tmp_path):
    path = str(tmp_path / "t")
    assert stored(spark, path) == [] and versions.version(path) == 0
    for n, (ids, model) in enumerate((((1, 2), "a"), ((2, 3), "b"), ((2, 3), "b")), 1):
        assert sinks.upsert_files(spark, path, rows(spark, ids, model)) == n
    want = [("1", "a"), ("2", "b"), ("3", "b")]
    assert stored(spark, path) == stored(spark, path, 2) == want and stored(spark, path, 1) == [("1", "a"), ("2", "a")]
    assert versions.clear(path) > 0 and stored(spark, path) == want and versions.clear(path) == 0
    rows(spark, (9,), "c").write.format("versioned").mode("append").option("path", path).save()
    assert stored(spark, path) == [*want, ("9", "c")]


def test_abort_leaves_the_old_table(spark, tmp_path):
    """A task that fails after others have written: nothing is named, and what they wrote goes."""
    path = str(tmp_path / "t")
    sinks.upsert_files(spark, path, rows(spark, (1, 2), "a"))
    before = set((tmp_path / "t" / "data").iterdir())

    @F.udf("string")
    def failing(key):
        raise ValueError("lost on the way")

    broken = rows(spark, range(3, 40), "b").withColumn("model", F.when(F.col("key") == "17", failing("key")).otherwise(F.col("model")))
    with pytest.raises(Exception, match="lost on the way"):
        broken.write.format("versioned").mode("overwrite").option("path", path).save()
    assert stored(spark, path) == [("1", "a"), ("2", "a")] and versions.version(path) == 1
    versions.clear(path)
    assert set((tmp_path / "t" / "data").iterdir()) == before


def test_of_two_writers_from_one_version_one_commits(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert_files(spark, path, rows(spark, (1,), "a"))
    sinks.upsert_files(spark, path, rows(spark, (2,), "b"))
    with pytest.raises(Exception, match="another write"):
        rows(spark, (3,), "c").write.format("versioned").mode("overwrite").options(path=path, base="1").save()
    assert stored(spark, path) == [("1", "a"), ("2", "b")]


def test_null_keys_are_appended_once(spark, tmp_path):
    schema = "k long, at long"
    spark.createDataFrame([(None, 2), (None, 1), (5, 3)], schema).coalesce(1).write.parquet(str(tmp_path / "a"))
    for n in range(2):
        q = incremental.append_new(incremental.read_files(spark, str(tmp_path / "a"), schema), str(tmp_path / "out"), "k", "at", str(tmp_path / f"check{n}"))
        q.awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == [(5, 3), (None, 1)]
