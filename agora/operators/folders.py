"""Folders that all executors share, for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir; a temporary one only where a session on one machine names none."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="agora-")
    return f"{base.rstrip('/')}/agora-files/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as it is read back from path: its lineage ends there."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Bytes of a batch for Python workers, and the setting that holds them.
BATCH, BATCH_BYTES = 1 << 22, "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(spark: SparkSession) -> SparkSession:
    """spark, its batches of texts for Python held to BATCH bytes, unless the session's owner has set another bound than Spark's."""
    if spark.conf.get(BATCH_BYTES, None) == "67108864b":
        spark.conf.set(BATCH_BYTES, str(BATCH))
    return spark
