"""Queries that ask a client for each row on executors: retries, completions, crawls, details. Answers follow from the asked address."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora import schemas
from agora.functions import shapes
from agora.operators import runs
from agora.operators.fold import backoff
from agora.plans.documents import scratch
from agora.plans.records import query, table
from agora.sources import crawl, files, rest


@query("src6_retried_requests", """SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'envelope' WHEN event_id % 7 = 0 THEN 'status 404' WHEN event_id % 6 = 5 THEN 'status 503' ELSE 'ok' END AS outcome,
    CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN 1 ELSE least(event_id % 6, 4) + 1 END AS asked,
    CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN 0 ELSE round((power(1.5, least(event_id % 6, 4)) - 1) / 0.5, 6) END AS waited FROM events""")
def src6(spark: SparkSession, d: str) -> DataFrame:
    """Requests that fail some times before they are answered, always, or in a way that is not tried again."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k in frame["event_id"]:
                asked, waited = [], []

                def get(url: str, k: int = k, asked: list = asked) -> dict:
                    asked.append(url)
                    if k % 11 == 0:
                        return {"status": "ERROR"}
                    if k % 7 == 0:
                        raise rest.Failed(404)
                    if len(asked) <= k % 6:
                        raise rest.Failed(503)
                    return {"status": "OK"}

                try:
                    rest.request(f"mem://events/{k}", get, sleep=waited.append)
                    outcome = "ok"
                except rest.Failed as e:
                    outcome = f"status {e.status}" if e.status else "envelope"
                out.append((k, outcome, len(asked), round(float(sum(waited)), 6)))
            yield pd.DataFrame(out, columns=["event_id", "outcome", "asked", "waited"])

    return table(spark, d, "events").select("event_id").mapInPandas(run, "event_id long, outcome string, asked long, waited double")


@query("f25_page_addresses", "SELECT page_id, url || '?limit=250&key=k' AS address FROM pages WHERE NOT contains(url, '?') AND NOT contains(url, '#') AND NOT contains(url, '%')")
def f25(spark: SparkSession, d: str) -> DataFrame:
    """A parameter is set, another added, and the first one replaced."""

    @F.pandas_udf("string")
    def address(urls: pd.Series) -> pd.Series:
        return urls.map(lambda u: rest.with_parameter(rest.with_parameter(rest.with_parameter(u, "limit", 20), "key", "k"), "limit", 250))

    plain = table(spark, d, "pages").where(~F.col("url").rlike("[?#%]"))
    return plain.select("page_id", address("url").alias("address"))


@query("f33_backoff", "SELECT event_id, least(30.0, 1.5 * power(2, event_id % 9)) AS seconds FROM events")
def f33(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("double")
    def seconds(attempt: pd.Series) -> pd.Series:
        return attempt.map(lambda k: float(backoff(int(k), 1.5, 30.0)))

    return table(spark, d, "events").select("event_id", seconds(F.col("event_id") % 9).alias("seconds"))


class _Answer(Exception):
    def __init__(self, status: int):
        super().__init__(str(status))
        self.status = status


@query("u2_completions", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'streamed' WHEN 1 THEN 'plain' WHEN 2 THEN 'streamed' WHEN 3 THEN 'failed 500' WHEN 4 THEN 'failed 401' ELSE 'streamed' END AS answer,
    CASE event_id % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 2 ELSE 2 END AS asked FROM events""")
def u2(spark: SparkSession, d: str) -> DataFrame:
    """A model that streams, refuses to stream, is out of order twice or for good, refuses either way, or takes too long once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for k in frame["event_id"]:
                asked: list[bool] = []

                def ask(stream: bool, kind: int = k % 6, asked: list = asked) -> str:
                    asked.append(stream)
                    if kind in (1, 4) and stream:
                        raise _Answer(404 if kind == 1 else 400)
                    if kind == 4:
                        raise _Answer(401)
                    if kind == 3 or kind == 2 and len(asked) < 3:
                        raise _Answer(500)
                    if kind == 5 and len(asked) == 1:
                        raise TimeoutError
                    return "streamed" if stream else "plain"

                try:
                    answer = runs.complete(ask, sleep=lambda s: None)
                except _Answer as e:
                    answer = f"failed {e.status}"
                out.append((k, answer, len(asked)))
            yield pd.DataFrame(out, columns=["event_id", "answer", "asked"])

    return table(spark, d, "events").select("event_id").mapInPandas(run, "event_id long, answer string, asked long")


def _site(url: str) -> str:
    """A member's site: two listings, the second leading back to the first, and two releases."""
    host, _, page = url.removeprefix("https://").partition("/")
    k = int(host.split(".")[0][1:])
    if k % 5 == 0:
        raise OSError("no route")
    if page.startswith("list"):
        link = f'<a href="/media/press-releases/r{page[-1]}">x</a>' if k % 5 != 1 else ""
        return f'{link}<a rel="next" href="/list{2 if page[-1] == "1" else 1}">more</a>'
    return f'<h1>Release {page[-1]} of {k}</h1><div class="col-auto">May {page[-1]}, 2026</div><div class="evo-press-release__body"><p>Body of {k}</p></div>'


@query("src14_crawled_releases", """SELECT 'S' || s_suppkey AS member, status, n AS release, CASE WHEN n IS NOT NULL THEN 'Release ' || n || ' of ' || s_suppkey END AS title, CASE WHEN n IS NOT NULL THEN 'May ' || n || ', 2026' END AS day, CASE WHEN n IS NOT NULL THEN 'Body of ' || s_suppkey END AS body
    FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 13 = 0 THEN 'skipped' WHEN s_suppkey % 5 = 0 THEN 'error' WHEN s_suppkey % 5 = 1 THEN 'no_releases' ELSE 'ok' END AS status FROM supplier),
    (SELECT unnest(['1', '2', NULL]) AS n) WHERE (status = 'ok') = (n IS NOT NULL)""")
def src14(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    start = F.when(F.col("s_suppkey") % 13 != 0, F.concat(F.lit("https://m"), F.col("s_suppkey").cast("string"), F.lit(".gov/list1")))
    rows = crawl.crawl_members(s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("bioguideId"), start.alias("start")), _site)
    return rows.select(F.col("bioguideId").alias("member"), "status", F.substring("url", -1, 1).alias("release"), "title", F.col("date").alias("day"), F.col("bodyText").alias("body"))


def _bill(url: str) -> dict:
    number = int(url.split("/bill/")[1].split("/")[2])
    if number % 7 == 0 or url.endswith("/summaries") and number % 3 == 0:
        raise OSError("down")
    if url.endswith("/summaries"):
        return {"summaries": [{"text": f"s{number}"}]}
    if url.endswith("/subjects"):
        return {"subjects": {"legislativeSubjects": [{"name": "tax"}]} if number % 2 else None}
    return {"bill": {"number": number}}


@query("src18_bill_details", """SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN '{"number": ' || o_orderkey || '}' END AS bill, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 THEN '[{"text": "s' || o_orderkey || '"}]' ELSE '[]' END AS summaries,
    CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 2 = 1 THEN '[{"name": "tax"}]' ELSE '[]' END AS subjects FROM orders""")
def src18(spark: SparkSession, d: str) -> DataFrame:
    bills = table(spark, d, "orders").select(F.lit(119).alias("congress"), F.lit("HR").alias("type"), F.col("o_orderkey").cast("string").alias("number"))
    return crawl.bill_details(bills, _bill, "mem://api").select(F.col("number").cast("long").alias("o_orderkey"), "bill", "summaries", "subjects")


_TOPICS = " || ".join(f"' {t.replace('_', ' ')}'" + (" || ' ' || lower(substr(s_name || repeat(' x', 200), 1, 240))" if t == schemas.TOPICS[2] else "") for t in schemas.TOPICS)


@query("p13_profile_search_text", f"SELECT s_suppkey, trim(regexp_replace(lower('member ' || s_name || {_TOPICS}), '\\s+', ' ', 'g')) AS searched FROM supplier")
def p13(spark: SparkSession, d: str) -> DataFrame:
    """Profiles with a summary of one topic, of which 240 letters are searched."""
    profile = F.create_map(F.lit(schemas.TOPICS[2]), F.concat("s_name", F.repeat(F.lit(" x"), 200)), F.lit("no topic"), F.lit("unseen"))
    return table(spark, d, "supplier").select("s_suppkey", shapes.profile_search_text([F.lit("Member"), F.col("s_name")], profile).alias("searched"))


@query("snk4_sorted_files", "SELECT p_brand AS topic, string_agg(p_size, ',' ORDER BY p_size) AS sizes FROM part GROUP BY p_brand")
def snk4(spark: SparkSession, d: str) -> DataFrame:
    """The lines of each topic's file as they stand in it."""
    path = scratch(spark, "sorted")
    files.write_by_key(table(spark, d, "part").select(F.col("p_brand").alias("topic"), "p_size"), path, "topic", "p_size")
    read = spark.read.schema("value string, topic string").text(path, wholetext=True)
    lines = F.filter(F.split("value", "\n"), lambda x: x != "")
    return read.select("topic", F.array_join(F.transform(lines, lambda x: F.get_json_object(x, "$.p_size")), ",").alias("sizes"))
