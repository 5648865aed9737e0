"""Sorts with a stated tie order, pages, samples of an exact size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.operators.folders import scratch

#: Rows up to which a page is the tail of a top-k.
SHALLOW = 10_000


def bill_order(field: Column, position: Column, descending: bool) -> list[Column]:
    """A field, then the position, both in the same direction."""
    return [field.desc(), position.desc()] if descending else [field.asc(), position.asc()]


def release_order(time: Column, position: Column, newest_first: bool) -> list[Column]:
    """By time; what has none counts as oldest; ties stay in their order."""
    return [time.desc_nulls_last() if newest_first else time.asc_nulls_first(), position.asc()]


def compact_order(congress: Column, kind: Column, number: Column) -> list[Column]:
    """Congress as text, type, number as a number (0 if it is none)."""
    return [congress.cast("string").asc(), kind.asc(), F.coalesce(number.cast("string").try_cast("int"), F.lit(0)).asc()]


def _ranges(rows: DataFrame, order: list[Column]) -> tuple[DataFrame, list[tuple[int, int]], str]:
    """rows in files by ranges of order, the number of rows in each range p, and the folder."""
    path = scratch(rows.sparkSession, "ranges")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()).write.partitionBy("_range").parquet(path)
    held = rows.sparkSession.read.schema(T.StructType([*rows.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(path)
    return held, sorted((r["_range"], r["n"]) for r in held.groupBy("_range").agg(F.count("*").alias("n")).collect()), path  # a row for each range


def page(rows: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """Page number (from 1) of sorted rows: a number beyond the last page gives the last, one below 1 the first.

    Pages among the first SHALLOW rows are a top-k. Deeper ones are found by the counts of ranges: only the ranges that hold the page
    are sorted, and no task has the rows before it."""
    if size < 1:
        raise ValueError("a page holds one row at least")
    total = rows.count()
    before = (min(max(1, number), max(1, -(-total // size))) - 1) * size
    if not total or before + size <= SHALLOW:
        return rows.orderBy(*order).offset(before).limit(size)
    held, counts, _ = _ranges(rows, order)
    chosen, at = [], 0
    for p, n in counts:
        if at + n > before and at < before + size:
            chosen.append((p, at))
        at += n
    return held.where(F.col("_range").isin([p for p, _ in chosen])).drop("_range").orderBy(*order).offset(before - chosen[0][1]).limit(size)


def positions(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with position, from 1, in an order without ties: each range of it is numbered by itself from where it begins."""
    held, counts, _ = _ranges(rows, order)
    starts, at = [], 0
    for p, n in counts:
        starts.append((p, at))
        at += n
    first = F.broadcast(rows.sparkSession.createDataFrame(starts, "_range int, _start long"))  # a row for each range
    return held.join(first, "_range").withColumn("position", F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_start")).drop("_range", "_start")


def top_per_group(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group, with rank. Spark keeps k rows of each group per task before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def sample(rows: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows exactly, the same for the same seed however rows are partitioned, in the order of key."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n).orderBy(key)


def matched_order(matched: Column, rank: Column) -> list[Column]:
    """Rows that match before all others, each part by rank."""
    return [(~matched).asc(), rank.asc()]


def matched_first(rows: DataFrame, matched: Column, rank: Column) -> DataFrame:
    return rows.orderBy(*matched_order(matched, rank))


def source_order(source: Column, first: tuple[str, ...]) -> list[Column]:
    """Named sources in their order, then the others by name."""
    rank = F.lit(len(first))
    for i, s in reversed(list(enumerate(first))):
        rank = F.when(source == s, i).otherwise(rank)
    return [rank.asc(), source.asc()]
