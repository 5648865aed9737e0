"""Search pipelines: facets first, then fuzzy or semantic scores, then pages."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.functions import text
from agora.functions.fuzzy import CUTOFF, token_set_score
from agora.operators.folders import bounded, scratch, written
from agora.operators.order import matched_first, release_order
from agora.operators.vectors import top_k


class Embedder(Protocol):
    """What turns texts into vectors; model names the space, so that vectors of two models are never compared."""

    model: str
    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Deterministic vectors from hashed words: for tests, and where no model is at hand."""

    def __init__(self, dim: int = 64):
        self.dim, self.model = dim, f"hash-{dim}"

    def __call__(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in (t or "").lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1.0 if h & 1 << 20 else -1.0
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(rows: DataFrame, source: str, embedder: Embedder, target: str = "embedding") -> DataFrame:
    """rows with vectors of a text column, in Arrow batches; null text counts as empty."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(list(embedder([t or "" for t in texts]).astype(np.float32)))

    return rows.withColumn(target, run(F.col(source))).withColumn("model", F.lit(embedder.model))


def fuzzy_scores(rows: DataFrame, query: str, searched: str) -> DataFrame:
    """rows with score, those under the cutoff left out; searched is normalised text. A blank query keeps all, without score."""
    q = " ".join(query.lower().split())
    if not q:
        return rows.withColumn("score", F.lit(None).cast("double"))
    bounded(rows.sparkSession)
    return rows.withColumn("score", token_set_score(F.col(searched), F.lit(q), CUTOFF)).where(F.col("score") >= CUTOFF)


def fuzzy_filter(rows: DataFrame, query: str, searched: str, position: str) -> DataFrame:
    """In the base order for a blank query, else by score and, where scores tie, position.

    What is found is written: a sort reads its rows twice, and would score all texts twice."""
    scored = fuzzy_scores(rows, query, searched)
    return scored.orderBy(position) if not query.strip() else written(scored, scratch(rows.sparkSession, "scored")).orderBy(F.desc("score"), F.asc(position))


def release_text(title: Column, member: Column, ident: Column, date: Column, url: Column, body: Column, html: Column) -> Column:
    return text.normalize(F.concat_ws(" ", title, member, ident, date, url, F.substring(body, 1, 800), F.substring(text.tags_to_spaces(html), 1, 800)))


def party_filter(party: Column, choice: str) -> Column:
    """all, "Third party" (neither of the two large ones), or an exact name."""
    if choice == "all":
        return F.lit(True)
    p = text.normalize(party)
    return ~F.contains(p, F.lit("republican")) & ~F.contains(p, F.lit("democrat")) if choice == "Third party" else F.coalesce(party == choice, F.lit(False))


def search_releases(releases: DataFrame, query: str = "", party: str = "all", state: str | None = None, member: str | None = None, newest_first: bool = True) -> DataFrame:
    """Filters, then the fuzzy filter, then by date again: scores choose rows, not their order."""
    rows = releases.where(party_filter(F.col("party"), party))
    rows = rows if state is None else rows.where(F.col("state") == state)
    rows = rows if member is None else rows.where(F.col("member") == member)
    return fuzzy_scores(rows, query, "search_text").orderBy(*release_order(F.col("time"), F.col("position"), newest_first))


def facet_filter(bills: DataFrame, congress: str | None = None, chamber: str | None = None, status: str | None = None, party: str | None = None, state: str | None = None) -> DataFrame:
    """Bills that meet all given facets; chamber means any vote's, party and state any proposer's."""
    for column, value in (("congress", congress), ("status", status)):
        bills = bills if value is None else bills.where(F.col(column) == value)
    for column, value in (("chambers", chamber), ("parties", party), ("states", state)):
        bills = bills if value is None else bills.where(F.array_contains(column, value))
    return bills


def search_bills(bills: DataFrame, order: list[Column], query: str = "", **facets: str | None) -> DataFrame:
    """Facets, then the fuzzy filter; with a query the order of scores replaces the chosen one."""
    rows = facet_filter(bills, **facets)
    return fuzzy_filter(rows, query, "search_text", "position") if query.strip() else rows.orderBy(*order)


def search_members(members: DataFrame, query: str = "", party: str = "all", state: str | None = None) -> DataFrame:
    """Members (party, state, search_text, position) of a party bucket ("all" for any) and a state, then the fuzzy filter over their
    profiles' text."""
    rows = members if party == "all" else members.where(text.party_bucket("party") == party)
    rows = rows if state is None else rows.where(F.col("state") == state)
    return fuzzy_filter(rows, query, "search_text", "position")


def search_stances(rows: DataFrame, query: str, rank: Column, most: int | None = None) -> DataFrame:
    """Issue rows, those that match first, each part by rank; most keeps the best rows only (a preview)."""
    q = " ".join(query.lower().split())
    score = token_set_score(F.col("search_text"), F.lit(q), 0.0 if most is None else CUTOFF) if q else F.lit(0.0)
    scored = rows.withColumn("score", score)
    if most is not None:
        return scored.where(F.col("score") >= CUTOFF).orderBy(F.desc("score"), rank).limit(most)
    return matched_first(scored, F.col("score") >= CUTOFF, rank)


def semantic(vectors: DataFrame, query: str, embedder: Embedder, k: int, id: str, least: float | None = 0.0, where: Column | None = None) -> DataFrame:
    """The k rows most like a text. vectors (id, embedding, model): those of another model raise."""
    other = vectors.where(F.col("model") != embedder.model).limit(1).count()
    if other:
        raise ValueError(f"vectors of another model than {embedder.model}")
    return top_k(vectors, [float(x) for x in embedder([query])[0]], k, id, "embedding", least, where)


def combined(parts: dict[str, DataFrame]) -> DataFrame:
    """Results of several collections one below the other, by kind, with the total number on each row."""
    rows = None
    for kind, df in parts.items():
        one = df.withColumn("kind", F.lit(kind))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    if rows is None:
        raise ValueError("no collection to search")
    total = rows.agg(F.count("*").alias("total"))
    return rows.crossJoin(F.broadcast(total))  # one row


def contradictions(statements: DataFrame, votes: DataFrame, score: Callable[[], Column] | None = None) -> DataFrame:
    """Candidate pairs of a member's statement and vote on one topic that point in opposite directions.

    statements (member, topic, statement_id, stance: supports or opposes), votes (member, topic, bill_id, vote). The two are joined
    on member and topic, so that pairs are bounded by what one member said and voted on one topic.
    """
    v = votes.withColumn("direction", F.when(F.lower("vote").isin("yea", "aye", "yes"), "supports").when(F.lower("vote").isin("nay", "no"), "opposes")).where("direction is not null")
    pairs = statements.join(v, ["member", "topic"]).where((F.col("stance").isin("supports", "opposes")) & (F.col("stance") != F.col("direction")))
    confidence = F.lit(0.5) if score is None else score()
    severity = F.when(confidence >= 0.9, "direct").when(confidence >= 0.7, "moderate").when(confidence >= 0.4, "weak").otherwise("nuanced")
    return pairs.select(F.sha1(F.concat_ws("||", "member", "topic", "statement_id", "bill_id")).alias("contradiction_id"), "member", "topic", "statement_id", "bill_id", "vote", "stance", severity.alias("severity"), confidence.alias("confidence"))
