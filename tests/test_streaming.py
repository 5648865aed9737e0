from pyspark.sql import functions as F

from agora.streaming import incremental


def test_one_run_or_many_give_the_same_table(spark, tmp_path):
    schema = "k long, at long, v string"
    rows = [(k % 7, k, f"v{k}") for k in range(30)]
    for name, parts in (("one", [rows]), ("many", [rows[:10], rows[10:11], rows[11:]])):
        for i, part in enumerate(parts):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / f"in{i}"))
            q = incremental.append_new(incremental.read_files(spark, str(tmp_path / name), schema), str(tmp_path / f"{name}-out"), "k", "at", str(tmp_path / f"{name}-check"))
            q.awaitTermination(120)
    got = [sorted(map(tuple, spark.read.parquet(str(tmp_path / f"{n}-out")).collect())) for n in ("one", "many")]
    assert got[0] == got[1] == sorted((k, k, f"v{k}") for k in range(7))


def test_merge_reuses_refreshes_and_deletes(spark):
    new = spark.createDataFrame([("t", "a", "h1", "m2", [1.0]), ("t", "b", "h2", "m2", [2.0])], "topic string, member string, h string, meta string, embedding array<double>")
    old = spark.createDataFrame([("t", "a", "h1", "m1", [9.0]), ("t", "b", "x", "m1", [9.0]), ("t", "c", "h", "m1", [9.0])], new.schema)
    got = {(r.member, r.meta, tuple(r.embedding)) for r in incremental.merge(new, old, ["topic", "member"], "h").collect()}
    assert got == {("a", "m2", (9.0,)), ("b", "m2", (2.0,))}
    scope = spark.createDataFrame([("a",), ("b",)], "member string")
    assert ("c", "m1", (9.0,)) in {(r.member, r.meta, tuple(r.embedding)) for r in incremental.merge(new, old, ["topic", "member"], "h", scope).collect()}


def test_windows_in_stream_and_table_agree(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).select("ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = incremental.windowed_counts(stream, "ts", "event_type", "1 day", "0 seconds").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = incremental.windowed_counts(events, "ts", "event_type", "1 day", "0 seconds")
    key = lambda df: sorted((str(r.start), r.event_type, r.n) for r in df.collect())
    assert key(spark.table("w")) == key(want)


def test_resume(spark):
    work, done = spark.range(4), spark.range(2)
    assert incremental.resume_window(done, work, "id", True).count() == 2 and incremental.resume_window(done, work, "id", False).count() == 4
