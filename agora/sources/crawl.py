"""Lists and pages that lead to others: master lists, crawls of releases, details with sub-requests, archives in order.

A client is a function from an address to text or JSON; tests use recorded answers and nothing here opens a connection by itself.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.sources import archives
from agora.sources.files import _Listing, page_parts
from agora.sources.rest import request

RELEASES = "url string, title string, date string, publishedTime string, bodyHtml string, bodyText string"


def master_bills(payload: Column, bill: str = "bill_id: long, number: string, change_hash: string") -> Column:
    """The bills of a master list in JSON, an object with a key for each and for the session: what has no bill_id goes."""
    each = F.map_values(F.from_json(F.get_json_object(payload, "$.masterlist"), "map<string, string>"))
    bills = F.transform(F.filter(each, lambda x: F.startswith(F.ltrim(x), F.lit("{"))), lambda x: F.from_json(x, f"struct<{bill}>"))
    return F.filter(bills, lambda b: b["bill_id"].isNotNull())


def crawl(start: str, get: Callable[[str], str], most: int | None = None) -> Iterator[tuple[str, ...]]:
    """Releases of the listing at start and of the pages that follow it, until one was seen before or most are read; details are
    fetched once each, in the order of their addresses."""
    from urllib.parse import urljoin

    seen: set[str] = set()
    found: set[str] = set()
    url: str | None = start
    while url and url not in seen and (most is None or len(seen) < most):
        seen.add(url)
        page = _Listing()
        page.feed(get(url))
        found |= {urljoin(url, x) for x in page.links}
        url = urljoin(url, page.next) if page.next else None
    for release in sorted(found):
        yield (release, *page_parts(get(release)))


def crawl_members(members: DataFrame, get: Callable[[str], str], most: int | None = None) -> DataFrame:
    """(bioguideId, status, error) and a release's columns: members (bioguideId, start), each crawled in one task by itself. A
    member without releases has one row and status no_releases, one whose crawl fails one row and status error, one without a
    start one row and status skipped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RELEASES.split(", ")]
        for frame in frames:
            for ident, start in zip(frame["bioguideId"], frame["start"], strict=True):
                status, error, rows = "skipped", None, []
                if start:
                    try:
                        rows = list(crawl(start, get, most))
                        status = "ok" if rows else "no_releases"
                    except Exception as e:  # one member's site must not end the run
                        status, error = "error", str(e)
                yield pd.DataFrame([(ident, status, error, *r) for r in rows or [(None,) * len(names)]], columns=["bioguideId", "status", "error", *names])

    return members.select("bioguideId", "start").mapInPandas(run, f"bioguideId string, status string, error string, {RELEASES}")


def bill_details(bills: DataFrame, get: Callable[[str], dict], base: str) -> DataFrame:
    """(congress, type, number, bill, summaries, subjects), the last three in JSON: bills (congress, type, number) with their
    details. A list whose request fails is empty; a bill whose own request fails is null, with empty lists."""

    def part(url: str, *path: str) -> object:
        answer = request(url, get, tries=1)
        for p in path:
            answer = (answer or {}).get(p)
        return answer

    def asked(url: str, *path: str) -> str:
        try:
            found = part(url, *path)
        except Exception:  # a missing list is an empty one
            found = None
        return json.dumps(found if isinstance(found, list) else [], sort_keys=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for congress, kind, number in zip(frame["congress"], frame["type"], frame["number"], strict=True):
                url = f"{base}/bill/{congress}/{str(kind).lower()}/{number}"
                try:
                    bill = json.dumps(part(url, "bill"), sort_keys=True)
                except Exception:  # details may fail for one bill
                    out.append((congress, kind, number, None, "[]", "[]"))
                    continue
                out.append((congress, kind, number, bill, asked(f"{url}/summaries", "summaries"), asked(f"{url}/subjects", "subjects", "legislativeSubjects")))
            yield pd.DataFrame(out, columns=["congress", "type", "number", "bill", "summaries", "subjects"])

    return bills.select("congress", "type", "number").mapInPandas(run, "congress int, type string, number string, bill string, summaries string, subjects string")


def first_archive(spark: SparkSession, paths: list[str], wanted: DataFrame, key: str = "member", decoded: Accumulator | None = None) -> DataFrame:
    """(key, archive, value): for each wanted member the content of member.json in the first of the archives that has one, the first
    such entry; -1 and null if none has, and another source must do. Only these entries are read."""
    keys = wanted.select(F.col(key).cast("string").alias(key)).distinct()
    if not paths:
        return keys.select(key, F.lit(-1).alias("archive"), F.lit(None).cast("string").alias("value"))
    named = spark.createDataFrame(list(enumerate(paths)), "place int, archive string")
    listed = archives.directory(named.select("archive").distinct()).where(F.endswith("name", F.lit(".json"))).join(named, "archive")
    listed = listed.withColumn(key, F.regexp_extract("name", r"([^/]*)\.json$", 1))
    best = listed.join(keys, key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*listed.drop(key).columns), F.struct("place", "position")).alias("e"))
    found = archives.texts(best.select(key, "e.*"), [key, "place"], decoded)
    return keys.join(found, key, "left").select(key, F.coalesce("place", F.lit(-1)).alias("archive"), "value")


def payload_releases(raw: Column) -> Column:
    """Releases from JSON of any of three shapes: a list, an object with pressReleases, an object with releases; else none."""
    kind = "array<struct<url: string, title: string, date: string, publishedTime: string, bodyHtml: string, bodyText: string>>"
    held = lambda name: F.from_json(F.get_json_object(raw, f"$.{name}"), kind)
    return F.when(F.startswith(F.ltrim(raw), F.lit("[")), F.from_json(raw, kind)).otherwise(F.coalesce(held("pressReleases"), held("releases"), F.array().cast(kind)))
