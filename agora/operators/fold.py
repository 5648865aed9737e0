"""Folds of ordered documents through a model, one member at a time, with state that must not lose evidence.

Members are independent and run in parallel; within one, order decides. A member's documents reach one task in their order, a
batch of rows at a time, and only the state stays; agora.streaming.folds keeps that state between runs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: From a profile {topic: evidence} and a document to the next profile; raising or losing evidence rejects it.
Step = Callable[[dict[str, int], str], dict[str, int]]


def counting_step(profile: dict[str, int], body: str) -> dict[str, int]:
    """A rule in place of a model: each topic counts the documents that name it."""
    words = set(body.lower().split())
    return {t: n + (t in words) for t, n in profile.items()}


def regressions(old: dict[str, int], new: dict[str, int]) -> list[str]:
    return [t for t, n in old.items() if new.get(t, 0) < n][:5]


def apply_step(profile: dict[str, int], body: str, step: Step, tries: int) -> tuple[dict[str, int], str]:
    """The next stable profile and what became of the document: blank, done or failed. Every try starts from the last stable one."""
    if not body.strip():
        return profile, "blank"
    for _ in range(max(1, tries)):
        try:
            new = step(dict(profile), body)
        except Exception:  # a model may fail in any way; the state then stays as it was
            continue
        if not regressions(profile, new):
            return new, "done"
    return profile, "failed"


def in_order(docs: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """docs (member, position, body) by member and position, each with its number k from 0 and the total of its member, and what
    states (member, profile, next_index, total) has of it as profile, at and had. Ties in position go by body."""
    w = Window.partitionBy("member").orderBy("position", "body")
    rows = docs.select("member", "position", F.coalesce("body", F.lit("")).alias("body"))
    if states is not None:
        rows = rows.join(states.select("member", "profile", F.col("next_index").alias("at"), F.col("total").alias("had")), "member", "left")
    else:
        rows = rows.select("*", F.lit(None).cast("map<string,int>").alias("profile"), F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("had"))
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return rows.select("*", (F.row_number().over(w) - 1).cast("long").alias("k"), F.count("*").over(whole).alias("total"))


def resumes(total: int, had: object, at: object) -> bool:
    """Whether a state can be taken up: the source has as many documents as then, and the next one lies in range."""
    return pd.notna(had) and int(had) == total and pd.notna(at) and 0 <= int(at) <= total


def taken_up(row: object, total: int, topics: list[str]) -> tuple[int, dict[str, int]]:
    """The next index and the profile with which a member's first row (profile, at, had) starts."""
    start = dict.fromkeys(topics, 0)
    if row.profile is not None and resumes(total, row.had, row.at):
        return int(row.at), start | dict(row.profile)
    return 0, start


def fold(docs: DataFrame, topics: list[str], step: Step = counting_step, batch: int = 1, most: int | None = None, tries: int = 3, states: DataFrame | None = None) -> DataFrame:
    """(member, topic, evidence, next_index, total, failed): docs (member, position, body) folded in order of position.

    batch joins that many documents for a step; most takes the first documents only. states (member, profile map<string,int>,
    next_index, total) resumes a member whose total is unchanged and whose next index lies in range; others start over.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for r in rows.itertuples(index=False):
                if r.k == 0:
                    total, failed, held = r.total if most is None else min(r.total, most), 0, []
                    start, profile = taken_up(r, total, topics)
                if start <= r.k < total:
                    held.append(r.body)
                if held and (len(held) == batch or r.k + 1 >= total):
                    profile, what = apply_step(profile, "\n".join(b for b in held if b.strip()), step, tries)
                    failed, held = failed + (what == "failed"), []
                if r.k + 1 == r.total:
                    out += [(r.member, t, profile[t], total, total, failed) for t in topics]
            yield pd.DataFrame(out, columns=["member", "topic", "evidence", "next_index", "total", "failed"])

    kind = dict(docs.dtypes)["member"]
    return in_order(docs, states).mapInPandas(run, f"member {kind}, topic string, evidence long, next_index long, total long, failed long")


def running_evidence(docs: DataFrame, by: str, position: str, counts: Column) -> DataFrame:
    """The fold whose step adds a condition of the document: a running sum, without Python."""
    w = Window.partitionBy(by).orderBy(position).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return docs.select(by, position, F.sum(F.when(counts, 1).otherwise(0)).over(w).cast("long").alias("evidence"))


def classify_candidates(releases: DataFrame, completed: DataFrame, most: int) -> DataFrame:
    """(member, releases, status): completed, over_limit, no_text or todo, the first that holds."""
    per = releases.groupBy("member").agg(F.count("*").alias("releases"), F.coalesce(F.bool_or(F.trim("body") != ""), F.lit(False)).alias("text"))
    done = per.join(completed.select("member").distinct().withColumn("done", F.lit(True)), "member", "left")
    status = F.when(F.col("done"), "completed").when(F.col("releases") > most, "over_limit").when(~F.col("text"), "no_text").otherwise("todo")
    return done.select("member", "releases", status.alias("status"))


def _pieces(x: object) -> list[str]:
    """Text in an answer's content: a string, or a list of strings and of objects with text."""
    if isinstance(x, str):
        return [x]
    found = [p.get("text") if isinstance(p, dict) else p for p in x] if isinstance(x, list) else []
    return [p for p in found if isinstance(p, str)]


def answer_text(answer: dict) -> str:
    """output_text, or else all text under output, or else the message of the first choice; trimmed."""
    if direct := "".join(_pieces(answer.get("output_text"))).strip():
        return direct
    under = [p for o in answer.get("output") or [] if isinstance(o, dict) for p in _pieces(o.get("content"))]
    if joined := "".join(under).strip():
        return joined
    first = next(iter(answer.get("choices") or []), None)
    message = first.get("message") if isinstance(first, dict) else None
    return "".join(_pieces(message.get("content"))).strip() if isinstance(message, dict) else ""


def event_text(lines: list[str]) -> str:
    """The text of a streamed answer, one event in JSON to a line, with or without "data:" before it.

    Blank and comment lines and the end mark are skipped, as is what is no JSON object; an error event raises; the text of the
    last whole answer beats the deltas; no text at all raises."""
    import json

    deltas, final = [], None
    for line in map(str.strip, lines):
        raw = line.removeprefix("data:").strip()
        if not raw or raw == "[DONE]" or line.startswith(":"):
            continue
        try:
            event = json.loads(raw)
        except ValueError:
            continue
        if not isinstance(event, dict):
            continue
        if event.get("type") in ("error", "response.error"):
            error = event.get("error", {})
            raise RuntimeError(f"the stream reports an error: {error.get('message', 'unknown') if isinstance(error, dict) else error}")
        for whole in (event.get("response"), event if isinstance(event.get("output"), list) else None):
            final = whole if isinstance(whole, dict) else final
        choice = next(iter(event.get("choices") or []), None) if isinstance(event.get("choices"), list) else None
        delta = choice.get("delta") if isinstance(choice, dict) else None
        deltas += [x for x in (event.get("delta"), event.get("text")) if isinstance(x, str)] + _pieces(event.get("output_text")) + _pieces(delta.get("content") if isinstance(delta, dict) else None)
    out = (answer_text(final) if final else "") or "".join(deltas).strip()
    if not out:
        raise RuntimeError("the stream holds no text")
    return out


def backoff(attempt: int, base: float, cap: float, jitter: float = 0.0) -> float:
    import random

    return min(cap, base * 2**attempt + (random.uniform(0, jitter) if jitter else 0.0))
