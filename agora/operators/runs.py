"""Runs of folds that stop and go on: states kept every few documents, statuses of members, answers remembered."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.operators.fold import Step, apply_step, backoff, classify_candidates, counting_step, in_order, resumes, taken_up  # noqa: F401

#: Answers after which a stream is given up for a plain request.
PLAIN = (400, 404, 405, 415, 422)


def fold_states(docs: DataFrame, topics: list[str], every: int, step: Step = counting_step, tries: int = 3, states: DataFrame | None = None, stop_after: int | None = None) -> DataFrame:
    """(member, profile, next_index, total, final): the states that a fold of docs (member, position, body) leaves, one after each
    every documents and one at the end. states (member, profile, next_index, total) are taken up where resumes() holds;
    stop_after ends each member's run after that many documents, as an interrupt would."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                if r.k == 0:
                    start, profile = taken_up(r, r.total, topics)
                    end = r.total if stop_after is None else min(r.total, start + stop_after)
                if start <= r.k < end:
                    profile, _ = apply_step(profile, r.body, step, tries)
                    if (r.k + 1 - start) % every == 0 and r.k + 1 < end:
                        out.append((r.member, dict(profile), r.k + 1, r.total, False))
                if r.k + 1 == r.total:
                    out.append((r.member, dict(profile), end, r.total, end == r.total))
            yield pd.DataFrame(out, columns=["member", "profile", "next_index", "total", "final"])

    kind = dict(docs.dtypes)["member"]
    return in_order(docs, states).mapInPandas(run, f"member {kind}, profile map<string,int>, next_index long, total long, final boolean")


def last_states(states: DataFrame) -> DataFrame:
    """Of each member's states the one that is furthest."""
    return states.groupBy("member").agg(F.max_by(F.struct("profile", "next_index", "total", "final"), "next_index").alias("s")).select("member", "s.*")


def run_status(docs: DataFrame, completed: DataFrame, states: DataFrame, most: int) -> DataFrame:
    """(member, releases, status) after a run: completed before it, over_limit, no_text, done, failed (its fold did not reach the
    end), or todo, in that order."""
    told = classify_candidates(docs, completed, most)
    now = last_states(states).select("member", "final")
    status = F.when(F.col("status") != "todo", F.col("status")).when(F.col("final"), "done").when(~F.col("final"), "failed").otherwise("todo")
    return told.join(now, "member", "left").select("member", "releases", status.alias("status"))


def complete(ask: Callable[[bool], str], tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> str:
    """A model's answer: ask(True) streams; answers of PLAIN give that up for ask(False); server errors and timeouts are tried
    again after a growing pause, and the last one raises. An error says its answer by its attribute status."""
    stream, last = True, None
    for attempt in range(max(1, tries)):
        try:
            return ask(stream)
        except Exception as e:  # which errors end it is decided by their answer
            status = getattr(e, "status", None)
            if stream and status in PLAIN:
                stream = False
                try:
                    return ask(False)
                except Exception as again:  # the plain request is tried like the first
                    e, status = again, getattr(again, "status", None)
            last = e
            if not isinstance(e, TimeoutError) and (status is None or status < 500):
                raise e
            if attempt + 1 < tries:
                sleep(backoff(attempt, 1.0, 30.0))
    raise last


def signature(path: str, modified: int, **parameters: object) -> str:
    """What a search's answer depends on: the file, its time, every filter; white space and case of the query do not count."""
    asked = {k: " ".join(str(v).lower().split()) if k == "query" else v for k, v in parameters.items()}
    return hashlib.sha1(json.dumps([path, modified, asked], sort_keys=True, default=str).encode()).hexdigest()


class Memo:
    """Answers by signature, the least lately used of which goes beyond most; a new signature starts at page 1."""

    def __init__(self, most: int = 32):
        self.most, self.held, self.failed = most, {}, {}
        self.last: str | None = None

    def get(self, key: str, make: Callable[[], DataFrame]) -> DataFrame:
        if key in self.held:
            self.held[key] = self.held.pop(key)
        else:
            self.held[key] = make().cache()
            if len(self.held) > self.most:
                self.held.pop(next(iter(self.held))).unpersist()
        return self.held[key]

    def page(self, key: str, asked: int) -> int:
        same, self.last = key == self.last, key
        return asked if same else 1

    def preload(self, spark: SparkSession, targets: dict[str, str], schema: str) -> None:
        """Read files ahead, each path once however it is spelled; what can't be read is recorded and raises nothing."""
        for path in sorted({os.path.realpath(p) for p in targets.values()}):
            try:
                key = signature(path, os.stat(path).st_mtime_ns)
                self.get(key, lambda p=path: spark.read.schema(schema).json(p, multiLine=True)).count()
            except Exception as e:  # readers fall back to the file itself
                self.failed[path] = str(e)
