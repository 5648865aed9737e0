"""Counts by bucket, shares, modes, totals and other aggregates of votes, files and issues. Buckets are fixed columns, so that
empty ones are zeros and partial sums are combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.functions import text

#: How sources spell a vote, by bucket.
FEDERAL = {"yea": ("yea", "aye", "yes"), "nay": ("nay", "no"), "present": ("present",), "notVoting": ("not voting", "not voting.")}
STATE = {"yea": ("yea", "yes", "aye"), "nay": ("nay", "no"), "notVoting": ("nv", "not voting", "abstain", "abstention"), "absent": ("absent", "excused")}
SUMMARY = ("Yea", "Nay", "Aye", "No", "Present", "Not Voting")
STATUSES = ("ok", "no_releases", "error", "skipped")


def bucket(vote: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The bucket of a vote, spelled in any case; other for what no bucket has, null too."""
    v = text.text_or_empty(F.lower(vote))
    out = F.lit("other")
    for name, words in table.items():
        out = F.when(v.isin(*words), name).otherwise(out)
    return out


def vote_counts(votes: DataFrame, by: list[str], vote: str, table: dict[str, tuple[str, ...]] = FEDERAL) -> DataFrame:
    b = votes.select(*by, bucket(F.col(vote), table).alias("b"))
    return b.groupBy(*by).agg(*(F.count_if(F.col("b") == name).alias(name) for name in (*table, "other")))


def vote_summary(votes: DataFrame, by: list[str], vote: str) -> DataFrame:
    """Counts of the exact spellings, zero-filled."""
    names = [F.count_if(F.col(vote) == s).alias(s.replace(" ", "_")) for s in SUMMARY]
    return votes.groupBy(*by).agg(*names, F.count_if(~F.coalesce(F.col(vote).isin(*SUMMARY), F.lit(False))).alias("Other"))


def shares(counts: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Long form: a row for each count over zero with its share of the row's total."""
    total = sum((F.col(n) for n in names), F.lit(0))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("bucket"), F.col(n).alias("n")) for n in names)))
    return counts.select(*by, total.alias("total"), rows.alias("x")).where("x.n > 0").select(*by, "x.bucket", "x.n", (F.col("x.n") / F.col("total")).alias("share"))


def mode(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """The most frequent value of each group, the least of those that tie; null and blank values don't count."""
    return rows.groupBy(*by).agg(F.mode(F.nullif(F.col(value), F.lit("")) if dict(rows.dtypes)[value] == "string" else F.col(value), True).alias(value))


def status_counts(rows: DataFrame, status: str, known: tuple[str, ...] = STATUSES) -> DataFrame:
    return rows.agg(*(F.count_if(F.col(status) == s).alias(s) for s in known))


def evidence_totals(issues: DataFrame, by: list[str], evidence: str = "evidence") -> DataFrame:
    return issues.groupBy(*by).agg(F.count_if(F.col(evidence) > 0).alias("issues_with_evidence"), F.coalesce(F.sum(evidence), F.lit(0)).alias("total_evidence"))


def evidence_regressions(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """(by, topic, before, after) where evidence fell; a topic that is missing counts as 0."""
    a, b = old.select(*by, "topic", F.col("evidence").alias("before")), new.select(*by, "topic", F.col("evidence").alias("after"))
    both = a.join(b, [*by, "topic"], "left").withColumn("after", F.coalesce("after", F.lit(0)))
    return both.where("after < before")


def latest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The last row of each group by order, which must tell all rows of a group apart: an aggregate, so that groups are combined
    before the shuffle and no group is sorted."""
    rest = [c for c in rows.columns if c not in by]
    whole = F.struct(*(F.col(c) for c in rest))
    return rows.groupBy(*by).agg(F.max_by(whole, F.struct(*order)).alias("x")).select(*by, *(F.col("x")[c].alias(c) for c in rest))


def earliest(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group by order: the rule "first wins" on an explicit position."""
    rest = [c for c in rows.columns if c not in by]
    whole = F.struct(*(F.col(c) for c in rest))
    return rows.groupBy(*by).agg(F.min_by(whole, F.struct(*order)).alias("x")).select(*by, *(F.col("x")[c].alias(c) for c in rest))


def bill_status(votes: DataFrame, by: list[str], result: str) -> DataFrame:
    """One label if all known outcomes agree, Mixed if not, Unknown without any."""
    known = votes.select(*by, F.nullif(text.vote_outcome(result), F.lit("Unknown")).alias("o"))
    lo, hi = F.min("o"), F.max("o")
    return known.groupBy(*by).agg(F.when(lo.isNull(), "Unknown").when(lo != hi, "Mixed").otherwise(lo).alias("status"))


def facet_values(rows: DataFrame, facets: list[str]) -> DataFrame:
    """(facet, value): distinct values of each facet that are not blank, in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets)))
    return rows.select(pairs.alias("p")).select("p.facet", "p.value").where("value is not null and value <> ''").distinct()


def embedding_index(vectors: DataFrame, by: str, vector: str, file: str | None = None, order: list[Column] | None = None, metadata: list[str] | None = None) -> DataFrame:
    """Per key: valid vectors, and their length if all agree, else null.

    With file and order also files, an array of (file, valid vectors) by the first place of each file, whether it has valid vectors
    or not; and of each of metadata the last value by order that is not empty."""
    n = F.size(vector)
    ok = F.col(vector).isNotNull() & (n > 0)
    total, least, most = F.count_if(ok), F.min(F.when(ok, n)), F.max(F.when(ok, n))
    known = [total.alias("total"), F.when(least == most, least).cast("long").alias("dimension")]
    if file is None:
        return vectors.where(ok).groupBy(by).agg(*known)
    at = F.struct(*order)
    last = [F.max_by(c, F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "", at)).alias(c) for c in metadata or []]
    per = vectors.groupBy(by, file).agg(F.min(at).alias("_at"), total.alias("valid"))  # combined before the list of a key's files
    listed = per.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(file).alias("file"), "valid"))), lambda x: F.struct(x["file"], x["valid"])).alias("files"))
    return vectors.groupBy(by).agg(*known, *last).join(listed, by)


def voting_profile(votes: DataFrame, by: str, order: list[Column], vote: Column, info: list[str]) -> DataFrame:
    """Per member: total_votes, votes (an array in order) and of each of info what the member's first vote has."""
    at = F.struct(*order)
    listed = F.sort_array(F.collect_list(F.struct(at.alias("at"), vote.alias("v"))))  # what one member has voted; array_sort would compare by a lambda
    return votes.groupBy(by).agg(F.count("*").alias("total_votes"), F.transform(listed, lambda x: x["v"]).alias("votes"), *(F.min_by(c, at).alias(c) for c in info))


def sizes(rows: DataFrame, by: list[Column | str]) -> DataFrame:
    """Rows of each group: clusters, clusters by member and so on."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"))


def versioned(rows: DataFrame, key: str) -> DataFrame:
    """(versioned, bills): how many keys have several rows, and how many keys there are."""
    return sizes(rows, [key]).agg(F.count_if(F.col("n") > 1).alias("versioned"), F.count("*").alias("bills"))


def profile_means(rows: DataFrame, by: str) -> DataFrame:
    """(members, votes, mean_votes) over all members."""
    return sizes(rows, [by]).agg(F.count("*").alias("members"), F.sum("n").alias("votes"), F.avg("n").alias("mean_votes"))


def mean_pool(tokens: DataFrame, by: list[str], position: str, value: str, mask: str) -> DataFrame:
    """Masked means over tokens, by place in the vector; the divisor is 1e-9 at least."""
    w = F.col(mask).cast("double")
    return tokens.groupBy(*by, position).agg((F.sum(F.col(value) * w) / F.greatest(F.sum(w), F.lit(1e-9))).alias("mean"))


def quantile(rows: DataFrame, value: str, q: float) -> DataFrame:
    return rows.agg(F.percentile(value, F.lit(q)).alias("quantile"))
