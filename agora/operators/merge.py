"""Joins, merges and dedup of records under explicit first-wins and last-wins rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.operators.counts import earliest, latest

#: Rows of a dimension that a join may broadcast, after they are counted.
BROADCAST_ROWS = 100_000


def dimension(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if it is counted to be small; else the optimizer decides, from sizes."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def join_first(left: DataFrame, right: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Inner join with the first matching row of right; null keys match nothing."""
    return left.join(earliest(right.where(F.col(key).isNotNull()), [key], order), key)


def member_votes(roll_calls: DataFrame, votes: DataFrame, keys: list[str], member: Column, order: list[Column]) -> DataFrame:
    """Each roll call in which a member voted, with the member's first vote in it by order; null keys match nothing."""
    return roll_calls.join(earliest(votes.where(member).where(" and ".join(f"`{k}` is not null" for k in keys)), keys, order), keys)


def rewritten(documents: DataFrame, votes: DataFrame, key: str, replaced: str = "votes", dropped: str = "bills") -> DataFrame:
    """Documents with the lists of votes (key, votes) in place of their own, null where there is none, and without bills."""
    rest = [c for c in documents.columns if c not in (replaced, dropped)]
    return documents.select(*rest).join(votes.select(key, replaced), key, "left")


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The distinct keys of left that right has not; a null key of left stays."""
    return missing(left.select(key).distinct(), right, key)


def union_of_sets(rows: DataFrame, by: str, columns: list[str], name: str) -> DataFrame:
    """Per group the sorted distinct values of several columns, nulls left out."""
    return rows.groupBy(by).agg(F.array_sort(F.array_union(F.collect_set(columns[0]), F.flatten(F.array(*(F.collect_set(c) for c in columns[1:]))))).alias(name))


def pairs(rows: DataFrame, first: str, second: str) -> DataFrame:
    return rows.select(first, second).distinct()


def join_last_nested(left: DataFrame, right: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """Left join with the last matching row of right as one struct, null without a match."""
    one = latest(right.where(F.col(key).isNotNull()), [key], order)
    rest = [c for c in one.columns if c != key]
    return left.join(one.select(key, F.struct(*rest).alias(name)), key, "left")


def with_defaults(left: DataFrame, right: DataFrame, key: str, defaults: dict[str, object], order: list[Column] | None = None) -> DataFrame:
    """Left join with a dimension; columns of defaults are filled where it has no row or a null. Of repeated keys the first row by
    order stands, without one the least."""
    one = earliest(right, [key], order or [F.col(c) for c in defaults]).select(key, *defaults)
    out = left.join(dimension(one), key, "left")
    return out.select(*left.columns, *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()))


def with_first(left: DataFrame, right: DataFrame, key: str, order: list[Column], defaults: dict[str, object]) -> DataFrame:
    """with_defaults() for identifiers in any case: keys are trimmed and in upper case on either side, and of right's rows with
    one key the first by order stands. Null keys match nothing."""
    canonical = F.upper(F.trim(F.col(key)))
    one = earliest(right.withColumn(key, canonical).where(F.col(key).isNotNull()), [key], order).select(key, *defaults)
    out = left.withColumn(key, canonical).join(dimension(one), key, "left")
    return out.select(*left.columns, *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in defaults.items()))


def present(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_semi")


def missing(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def classify(candidates: DataFrame, existing: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """(keys, action): reuse where digests agree, embed where they differ or the key is new, delete where no candidate is left."""
    a = candidates.select(*keys, F.col(digest).alias("new"), F.lit(True).alias("wanted"))
    b = existing.select(*keys, F.col(digest).alias("old"), F.lit(True).alias("known"))
    action = F.when(F.col("wanted").isNull(), "delete").when(F.col("old").eqNullSafe(F.col("new")) & F.col("known").isNotNull(), "reuse").otherwise("embed")
    return a.join(b, keys, "full").select(*keys, action.alias("action"))


def side_by_side(issues: DataFrame, by: list[str], source: str, value: str, names: tuple[str, str]) -> DataFrame:
    """One row per key with the value of either source, null where it has none: a pivot of two fixed columns, no self-join."""
    return issues.groupBy(*by).agg(*(F.max(F.when(F.col(source) == s, F.col(value))).alias(f"{s}_{value}") for s in names))


def subjects_to_issues(subjects: DataFrame, mapping: list[tuple[str, str]], subject: str = "subject") -> DataFrame:
    """subjects with issue: that of the equal key, or else of the first key, in the order of mapping, that the subject contains
    in any case; subjects without one go. The mapping is a literal, so that no join is needed."""
    exact = F.coalesce(*(F.when(F.col(subject) == k, F.lit(v)) for k, v in mapping))
    part = F.coalesce(*(F.when(F.contains(F.lower(subject), F.lit(k.lower())), F.lit(v)) for k, v in mapping))
    return subjects.withColumn("issue", F.coalesce(exact, part)).where("issue is not null")


def merge_bills(bills: DataFrame) -> DataFrame:
    """Versions of a bill as one row: bills (bill_key, position, update_date, title, summary, parties, states, votes) becomes
    bill_key, title, summary, latest_update, parties, states, vote_count, raw_votes, version_count.

    Bills without votes are left out. The summary is the newest version's by the text of its date, the first of those that tie;
    the title the last one that is not blank; parties and states are unions without "Unknown"; of votes with one key the first
    stays. votes is an array of keys. A bill of very many versions is combined before the shuffle but for its distinct votes.
    """
    voted = bills.where(F.size("votes") > 0)
    newest = F.struct(F.coalesce("update_date", F.lit("")).alias("d"), (-F.col("position")).alias("p"))
    titled = F.when(F.coalesce("title", F.lit("")) != "", F.col("position"))
    union = lambda c: F.array_sort(F.array_except(F.array_distinct(F.flatten(F.collect_set(c))), F.array(F.lit("Unknown"))))
    heads = voted.groupBy("bill_key").agg(
        F.max_by("title", titled).alias("title"), F.max_by("summary", newest).alias("summary"), F.max("update_date").alias("latest_update"), union("parties").alias("parties"), union("states").alias("states"),
        F.sum(F.size("votes")).alias("raw_votes"), F.count("*").alias("version_count"),
    )
    votes = voted.select("bill_key", F.explode("votes").alias("vote")).distinct().groupBy("bill_key").agg(F.count("*").alias("vote_count"))
    return heads.join(votes, "bill_key")


def totals(bills: DataFrame) -> DataFrame:
    """Input rows, rows with votes, distinct bills, votes as they came and once each."""
    voted = bills.where(F.size("votes") > 0)
    a = bills.agg(F.count("*").alias("input_rows"), F.count_if(F.size("votes") > 0).alias("voted_rows"), F.coalesce(F.sum(F.when(F.size("votes") > 0, F.size("votes"))), F.lit(0)).alias("raw_votes"))
    b = voted.agg(F.countDistinct("bill_key").alias("bills"))
    c = voted.select("bill_key", F.explode("votes").alias("v")).distinct().agg(F.count("*").alias("votes"))
    return a.crossJoin(F.broadcast(b)).crossJoin(F.broadcast(c))  # one row each
