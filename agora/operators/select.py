"""Which rows count: votes of one chamber, members chosen for a run, sources, points; and the rows that lists show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora import schemas
from agora.functions import shapes, text


def house_member_votes(bills: DataFrame, member: str | None = None) -> DataFrame:
    """One row for each member's vote in the House: bills (votes: schemas.VOTE and other columns). Votes without an id go;
    member keeps one member's."""
    rest = [c for c in bills.columns if c != "votes"]
    calls = bills.select(*rest, F.explode("votes").alias("v")).where("v.chamber = 'House'")
    rows = calls.select(*rest, F.coalesce("v.recordedAt", F.lit("")).alias("voteDate"), "v.rollNumber", F.explode("v.members").alias("m"))
    rows = rows.where(F.coalesce("m.bioguideId", F.lit("")) != "").select(*rest, "voteDate", "rollNumber", "m.bioguideId", "m.name", "m.party", "m.state", "m.voteCast")
    return rows if member is None else rows.where(F.col("bioguideId") == member)


def select_members(members: DataFrame, current_only: bool = True, ids: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Members with an id, in the House now if asked for, among ids if there are any; by name and id, the first most of them."""
    rows = members.where(F.coalesce("bioguideId", F.lit("")) != "")
    rows = rows.where(shapes.current_house_member(F.col("terms"))) if current_only else rows
    rows = rows.where(F.col("bioguideId").isin(*ids)) if ids else rows
    rows = rows.orderBy(F.coalesce("name", F.lit("")), "bioguideId")
    return rows if most is None else rows.limit(most)


def summarised(votes: DataFrame, by: str, order: list[Column], most: int | None = None) -> DataFrame:
    """Votes whose summary is not empty, of each member the first most by order."""
    rows = votes.where(F.coalesce("summary", F.lit("")) != "")
    if most is None:
        return rows
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("_rank") <= most).drop("_rank")


def matching_members(members: DataFrame, asked: str, columns: tuple[str, ...] = ("bioguideId", "name", "partyName", "state")) -> DataFrame:
    """Members of whom one of columns holds the asked text, white space and case aside; a blank question keeps all."""
    q = " ".join(asked.lower().split())
    hit = F.lit(not q)
    for c in columns:
        hit = hit | F.contains(text.normalize(F.col(c)), F.lit(q))
    return members.where(hit)


def uncertain(points: DataFrame, least: float, column: str = "uncertainty") -> DataFrame:
    """Points whose uncertainty is known and no less than least."""
    return points.where(F.col(column).isNotNull() & (F.col(column) >= least))


def from_folder(files: DataFrame, folder: str, column: str = "sourceFolder") -> DataFrame:
    """Files of one source folder; "Any" keeps all."""
    return files if folder == "Any" else files.where(F.coalesce(column, F.lit("")) == folder)


def biggest_file(files: DataFrame, by: str, folder: str = "Any") -> DataFrame:
    """Of each member's files of a folder the one with the most vectors, of equal ones the latest, then the last by path."""
    rows = from_folder(files, folder)
    rank = F.struct(F.coalesce("embeddingCount", F.lit(0)), F.coalesce("mtimeNs", F.lit(0).cast("long")), "path")
    return rows.groupBy(by).agg(F.max_by(F.struct("path", "embeddingCount", "mtimeNs"), rank).alias("f")).select(by, "f.*")


def only_members(members: DataFrame, ids: list[str], key: str = "bioguideId") -> DataFrame:
    """Members of the given ids; no ids, no members."""
    return members.where(F.col(key).isin(*ids)) if ids else members.limit(0)


def run_counters(source: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """One row: how many keys the source has, how many of them are stored already (skipped), how many are new, and how many are
    stored in all. Null keys count for nothing."""
    a, b = source.select(key).where(F.col(key).isNotNull()).distinct(), existing.select(key).where(F.col(key).isNotNull()).distinct()
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), key, "full")
    n = lambda c: F.count_if(c)
    return both.agg(F.count("a").alias("source"), F.count("b").alias("existing"), n(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("skipped"), n(F.col("b").isNull()).alias("new"))


def run_envelope(fetched: DataFrame, resumed: DataFrame, enriched: DataFrame, key: str, years: int, started: str, until: str) -> DataFrame:
    """One row about a run: its window in days (a year has 365), how many rows were fetched, resumed and enriched, how many are
    left, and whether it is partial."""
    end = F.to_timestamp(F.lit(until))
    counts = [df.select(F.count(key).alias(n)) for df, n in ((fetched, "fetchedBillsCount"), (resumed, "resumedBillsCount"), (enriched, "enrichedBillsCount"))]
    row = counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each
    left = F.greatest(F.col("fetchedBillsCount") - F.col("enrichedBillsCount"), F.lit(0).cast("long"))
    window = F.date_format(end - F.expr(f"make_dt_interval({365 * int(years)})"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return row.select(F.lit(started).alias("runStartedAtUtc"), F.lit(int(years)).alias("yearsBack"), window.alias("windowFromUtc"), F.date_format(end, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("windowToUtc"), "fetchedBillsCount", "resumedBillsCount", "enrichedBillsCount", left.alias("remainingBillsCount"), (left > 0).alias("isPartial"))


def issue_rows(profiles: DataFrame) -> DataFrame:
    """A row for each of the fixed topics of profiles (member, source, profile: map of topic to summary and evidence): label, the
    summary, evidence of 0 at least, and a search text with 600 characters of the summary. A topic that is missing counts as empty."""
    topic = F.explode(F.array(*(F.lit(t) for t in schemas.TOPICS))).alias("topic")
    rows = profiles.select("member", "source", "profile", topic).withColumn("x", F.try_element_at("profile", F.col("topic")))
    summary, evidence = F.coalesce("x.summary", F.lit("")), F.greatest(F.coalesce("x.evidence", F.lit(0)), F.lit(0)).cast("long")
    searched = text.normalize(F.concat_ws(" ", "member", "source", F.replace("topic", F.lit("_"), F.lit(" ")), F.substring(summary, 1, 600)))
    return rows.select("member", "source", "topic", text.topic_name("topic").alias("label"), summary.alias("summary"), evidence.alias("evidence"), searched.alias("search_text"))


def release_vector_rows(releases: DataFrame) -> DataFrame:
    """Releases that have a vector, with defaults: idx is the place in the list, and names a release without a title."""
    title = F.coalesce(F.nullif("title", F.lit("")), F.format_string("Press release %d", F.col("idx") + 1))
    day = F.coalesce(F.nullif("date", F.lit("")), F.nullif("publishedTime", F.lit("")), F.lit("-"))
    return releases.where(F.size(F.coalesce("embedding", F.array().cast("array<float>"))) > 0).select("idx", title.alias("title"), day.alias("date"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("textSource", F.lit("")).alias("textSource"), F.coalesce("bodyCharCount", F.lit(0)).alias("bodyCharCount"), "embedding")


def topic_vector_rows(rows: DataFrame, topic: str) -> DataFrame:
    """Issue vectors of one topic: ids in upper case, a sentence where there is no summary, evidence 0 where there is none."""
    summary = text.text_or_empty("summary")
    title = F.when(summary != "", summary).otherwise(F.lit(f"No summary available for {topic.replace('_', ' ')}."))
    return rows.where(F.size(F.coalesce("embedding", F.array().cast("array<float>"))) > 0).select(
        F.upper(text.text_or_empty("bioguideId")).alias("memberId"), F.lit(topic).alias("topic"), title.alias("title"), F.coalesce(F.nullif("updatedAt", F.lit("")), F.lit("-")).alias("date"), F.lit("").alias("url"),
        F.coalesce("sourceIssueFile", F.lit("")).alias("textSource"), F.char_length(summary).alias("bodyCharCount"), F.coalesce("evidence", F.lit(0)).alias("evidence"), F.coalesce("summaryHash", F.lit("")).alias("summaryHash"), "embedding",
    )
