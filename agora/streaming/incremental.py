"""Incremental runs: each micro-batch meets what is stored, so that one run or many give the same tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from agora.operators.counts import earliest


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table under path, empty where nothing was written yet."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def append_new(source: DataFrame, path: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Rows whose key is not stored yet, the first of each key in a batch by order, are appended. A batch that is run again after
    a failure finds its rows stored and adds none. Rows without a key are one key: the first of them is appended once."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields)

    def run(batch: DataFrame, _: int) -> None:
        known = stored(batch.sparkSession, path, schema).select(F.col(key).alias("_known"))
        fresh = batch.join(known, F.col(key).eqNullSafe(F.col("_known")), "left_anti")
        earliest(fresh, [key], [F.col(order)]).select(*source.columns).write.mode("append").parquet(path)

    return source.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge(candidates: DataFrame, existing: DataFrame, keys: list[str], digest: str, scope: DataFrame | None = None) -> DataFrame:
    """The table after a run: rows with an equal digest keep their vector under fresh metadata, others get that of the candidate,
    rows without a candidate go, but for those out of scope (scope holds values of keys[-1])."""
    rest = [c for c in candidates.columns if c not in (*keys, digest, "embedding")]
    a = candidates.alias("a").join(existing.alias("b"), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], "left")
    same = (F.col(f"a.{digest}") == F.col(f"b.{digest}")) & (F.size("b.embedding") > 0)
    now = a.select(*(F.col(f"a.{k}") for k in keys), F.col(f"a.{digest}"), *(F.col(f"a.{c}") for c in rest), F.when(same, F.col("b.embedding")).otherwise(F.col("a.embedding")).alias("embedding"))
    if scope is None:
        return now
    return now.unionByName(existing.join(scope.select(keys[-1]).distinct(), keys[-1], "left_anti").select(*now.columns))


def windowed_counts(events: DataFrame, time: str, key: str, window: str, late: str) -> DataFrame:
    """Counts and sums per window and key, closed when the watermark passes; works on streams and tables alike."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def resume_window(done: DataFrame, work: DataFrame, key: str, same_window: bool) -> DataFrame:
    """What is left of a list of work: all of it unless the earlier run had the same window."""
    return work.join(done.select(key).distinct(), key, "left_anti") if same_window else work


def read_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(os.fspath(path))
