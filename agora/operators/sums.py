"""Sums of arrays over all tasks, added up on the executors in a tree, so that the driver gets one array however many tasks there are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Arrays that one task of the tree adds up.
FAN = 16
_PART = "place int, x binary"


def _added(t: pa.Table) -> pa.Table:
    order = np.argsort(t.column("place").to_numpy(), kind="stable")
    held = t.column("x")
    total = sum(np.frombuffer(held[int(i)].as_buffer()) for i in order)
    return pa.table({"place": pa.array([t.column("place")[int(order[0])].as_py() // FAN], pa.int32()), "x": pa.array([total.tobytes()], pa.binary())})


def tree_sum(rows: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None]) -> np.ndarray | None:
    """The sum of part(batches), an array of doubles, over the partitions of rows; None where part gives none for any of them.

    Parts of FAN tasks are added by one, and so on up: by the order of partitions, so that a sum does not depend on which ends first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        if (x := part(batches)) is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.asarray(x, float).ravel().tobytes()], pa.binary())], names=["place", "x"])

    parts, left = rows.mapInArrow(run, _PART), rows.rdd.getNumPartitions()
    while left > 1:
        parts = parts.groupBy(F.floor(F.col("place") / FAN).alias("group")).applyInArrow(_added, _PART)
        left = -(-left // FAN)
    found = parts.collect()  # one row at most
    return np.frombuffer(found[0]["x"]) if found else None
