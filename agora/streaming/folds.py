"""Folds as keyed state of a stream: each member's profile outlives the run, and a query that stops goes on from its checkpoint.

Documents may come in any order and in any number of batches. What is ahead of its turn waits in the state store, one entry for
each position, so that neither a member nor a batch of it is ever held as a whole. States are handed on after every few documents
and at a member's end; in a run that stays, also some seconds after the first document that was not handed on.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from agora.operators.fold import Step, apply_step, counting_step, resumes

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Settings of the caller's session that a session for streams takes over.
_KEPT = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone")


def session(spark: SparkSession) -> SparkSession:
    """A session beside spark whose state store can hold keyed collections; spark's own settings stay as they are."""
    out = spark.newSession()
    for name in _KEPT:
        if (value := spark.conf.get(name, None)) is not None:
            out.conf.set(name, value)
    out.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return out


class Fold(StatefulProcessor):
    """Rows (member, position, body, total) to states (member, profile, next_index, total, final).

    Positions count from 0; of two documents at one position the first that comes stands, and those behind the fold's place are
    ignored, so that a batch that comes again changes nothing. A null body is blank. A member whose total changes starts over when
    its documents come again from position 0, as states of another total can't be taken up."""

    def __init__(self, topics: list[str], every: int, seconds: float | None, step: Step, tries: int):
        self.topics, self.every, self.seconds, self.step, self.tries = topics, every, seconds, step, tries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "profile string, at long, total long, unsaved long")
        self.waiting = handle.getMapState("waiting", "position long", "body string")

    def _state(self) -> tuple[dict[str, int], int, int | None, int]:
        if not self.now.exists():
            return dict.fromkeys(self.topics, 0), 0, None, 0
        profile, at, total, unsaved = self.now.get()
        return dict.fromkeys(self.topics, 0) | json.loads(profile), at, total, unsaved

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802  the interface's name
        """A state that an earlier run has left: (member, profile in JSON, next_index, total)."""
        r = initialState.iloc[0]
        self.now.update((r["profile"], int(r["next_index"]), int(r["total"]), 0))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        profile, at, had, unsaved = self._state()
        first, out = unsaved == 0, []
        for part in rows:
            for r in part.sort_values("position").itertuples(index=False):
                if had != r.total:
                    if not resumes(r.total, had, at):
                        profile, at, unsaved = dict.fromkeys(self.topics, 0), 0, 0
                        self.waiting.clear()
                    had = r.total
                body = "" if pd.isna(r.body) else r.body
                if r.position != at:
                    if r.position > at and not self.waiting.containsKey((r.position,)):
                        self.waiting.updateValue((r.position,), (body,))
                    continue
                while body is not None:
                    profile, _ = apply_step(profile, body, self.step, self.tries)
                    at, unsaved, body = at + 1, unsaved + 1, None
                    if unsaved >= self.every or at == had:
                        out.append((*key, dict(profile), at, had, at == had))
                        unsaved = 0
                    if self.waiting.containsKey((at,)):
                        (body,) = self.waiting.getValue((at,))
                        self.waiting.removeKey((at,))
            yield self._rows(out)
            out = []
        self.now.update((json.dumps(profile), at, had, unsaved))
        if unsaved and first and self.seconds is not None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + int(self.seconds * 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        profile, at, total, unsaved = self._state()
        if unsaved:
            self.now.update((json.dumps(profile), at, total, 0))
            yield self._rows([(*key, profile, at, total, False)])

    @staticmethod
    def _rows(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["member", "profile", "next_index", "total", "final"])

    def close(self) -> None:
        pass


def states(docs: DataFrame, topics: list[str], every: int = 20, seconds: float | None = None, step: Step = counting_step, tries: int = 3, before: DataFrame | None = None) -> DataFrame:
    """(member, profile, next_index, total, final) of a stream of docs (member, position, body, total) from session().

    before (member, profile map<string,int>, next_index, total), read in that session too, holds states to go on from. seconds sets
    timers, for a run by processingTime: under availableNow Spark would wait for timers without end."""
    kind = dict(docs.dtypes)["member"]
    shape = f"member {kind}, profile map<string,int>, next_index long, total long, final boolean"
    first = None if before is None else before.select("member", F.to_json("profile").alias("profile"), "next_index", "total").groupBy("member")
    rows = docs.select("member", F.col("position").cast("long").alias("position"), "body", F.col("total").cast("long").alias("total"))
    return rows.groupBy("member").transformWithStateInPandas(statefulProcessor=Fold(topics, every, seconds, step, tries), outputStructType=shape, outputMode="Update", timeMode="None" if seconds is None else "ProcessingTime", initialState=first)


def keep(found: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Write states under path, a folder for each batch: one that runs again after a failure replaces what it had written."""

    def run(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return found.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def kept(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """All states under path."""
    return spark.read.schema(f"member {kind}, profile map<string,int>, next_index long, total long, final boolean").parquet(path)
