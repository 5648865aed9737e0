"""What several operators of this package need: shared folders, size-checked joins, sources."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most 64 bytes that a join may broadcast (32 MB); beyond it both sides are shuffled.
BROADCAST_ROWS = 500_000
BATCH, BATCH_BYTES = 1 << 22, "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where a session on one machine names none, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="agora-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder, by these options of the writer, and read it back: the lineage ends there, and lost executors
    cost one task each."""
    path = f"{shared_dir(df.sparkSession)}/agora/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(df: DataFrame) -> None:
    """Delete what cut() wrote, when nothing will read it again."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if re.search(r"/agora/[^/]+-[0-9a-f]{32}$", path):
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it is counted to be small; otherwise as it is."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def release(spark: SparkSession) -> None:
    """Collect garbage on the driver: only then does Spark's cleaner see which shuffle files and broadcasts of rounds that are
    over can go, on the driver and on the executors."""
    gc.collect()
    spark._jvm.System.gc()


def bounded(spark: SparkSession) -> SparkSession:
    """spark, its batches for Python workers held to BATCH bytes, unless the session's owner has set another bound than Spark's.

    A batch exists several times in a task's memory, in the JVM and in the worker."""
    if spark.conf.get(BATCH_BYTES, None) == "67108864b":
        spark.conf.set(BATCH_BYTES, str(BATCH))
    return spark


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which the worker hands memory that it no longer uses back to the system: workers outlive their
    tasks, and those of earlier stages stay beside those of the next."""

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return done


def look_up(rows: DataFrame, found: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """rows joined with found, which has one row for each key of on and, in count, how many of rows have that key.

    Few keys are broadcast. Of more, those with over one in BROADCAST_ROWS of all rows are: they are fewer than that. Any other
    key has too few rows to weigh on a task, and both sides are shuffled. found is read several times: write it first. Of
    joins, "inner" and "left" can be made; under "left" rows with a null key stay as they are.
    """
    n, total = found.agg(F.count("*"), F.sum(count)).first()
    found = found.withColumnRenamed(count, "_count")
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(found.drop("_count")), on, how)
    hot = F.broadcast(found.where(F.col("_count") > total / BROADCAST_ROWS).drop("_count"))
    cold = found.where(F.col("_count") <= total / BROADCAST_ROWS).drop("_count")
    whole = " and ".join(f"`{c}` is not null" for c in on)
    keyed = rows.where(whole)
    out = keyed.join(hot, on).unionByName(keyed.join(hot.select(*on), on, "left_anti").join(cold, on, how))
    return out if how == "inner" else out.unionByName(rows.where(f"not ({whole})"), allowMissingColumns=True)


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name
