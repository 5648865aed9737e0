"""Tables of vectors: upserts by an identity that follows from the row, and what a collection holds."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.functions import keys
from agora.operators.counts import latest
from agora.sources import versions


def vector_rows(rows: DataFrame, by: list[str], vector: str, model: str, payload: Column) -> DataFrame:
    """(id, key, embedding, model, payload): the id is the digest of the row's own key, so that loading twice adds nothing."""
    return rows.where(F.col(vector).isNotNull()).select(keys.sha1_key(*(F.col(c) for c in by)).alias("id"), F.concat_ws("-", *by).alias("key"), F.col(vector).cast("array<float>").alias("embedding"), F.lit(model).alias("model"), F.to_json(payload).alias("payload"))


def upserted(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """stored with fresh rows in place of those of their id; of fresh rows with one id the last by payload stands."""
    new = latest(fresh, ["id"], [F.col("payload"), F.col("key"), F.to_json("embedding"), F.col("model")])
    return stored.join(new.select("id"), "id", "left_anti").unionByName(new.select(*stored.columns))


def upsert(spark: SparkSession, table: str, fresh: DataFrame) -> None:
    """Write the upserted collection to a folder of its own, then let the table point there: one change of the catalog, so that
    readers see one or the other, and a crash before it leaves the old one. The old folder stays for readers under way."""
    place = spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Location'").first()["data_type"].rstrip("/")
    path = f"{re.sub('-[0-9a-f]{32}$', '', place)}-{uuid.uuid4().hex}"
    upserted(spark.table(table), fresh).write.format(spark.sql(f"DESCRIBE FORMATTED {table}").where("col_name = 'Provider'").first()["data_type"]).save(path)
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
    spark.catalog.refreshTable(table)


def upsert_files(spark: SparkSession, path: str, fresh: DataFrame) -> int:
    """Upsert a collection of files under path (agora.sources.versions) by a committed write; its new version. A table that does
    not exist begins with fresh; loading twice adds nothing."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh.schema.fields)
    spark.dataSource.register(versions.Versioned)
    base = versions.version(path)
    upserted(versions.read(spark, path, schema, base), fresh).write.format("versioned").mode("overwrite").options(path=path, base=str(base)).save()
    return base + 1


def collection_stats(collections: dict[str, DataFrame], vector: str = "embedding") -> DataFrame:
    """(collection, points, dimension): how many vectors each holds, and their length if all agree."""
    out = None
    for name, df in collections.items():
        n = F.size(vector)
        one = df.where(F.col(vector).isNotNull()).agg(F.lit(name).alias("collection"), F.count("*").alias("points"), F.when(F.min(n) == F.max(n), F.min(n)).alias("dimension"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no collection")
    return out
