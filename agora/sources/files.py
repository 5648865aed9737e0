"""Readers and writers of documents in files: JSON, archives, XML, HTML, member lists, one file per key."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora import schemas
from agora.functions import text
from agora.functions.fuzzy import repair_text
from agora.sources import archives


def json_documents(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Whole-file JSON under an explicit schema, with the file's name; what does not fit it is null."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="PERMISSIVE").withColumn("_file", F.col("_metadata.file_name"))


def zipped_json(spark: SparkSession, path: str, schema: str, decoded: Accumulator | None = None) -> DataFrame:
    """The first .json of each archive; an object is a row, an array a row for each element. Archives without one give none."""
    listed = archives.directory(archives.paths(spark, path)).where(F.endswith("name", F.lit(".json")))
    first = listed.groupBy("archive").agg(F.min_by(F.struct(*listed.columns), "position").alias("e")).select("e.*")
    return archives.json_rows(first, decoded).select(F.from_json("value", T.StructType.fromDDL(schema)).alias("d")).select("d.*")


def release_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus of members by id as one row per release: members whose status is error are left out."""
    rows = json_documents(spark, path, schemas.CORPUS)
    return releases_of(rows)


def releases_of(corpus: DataFrame) -> DataFrame:
    members = corpus.select(F.explode("membersByBioguideId").alias("key", "m")).where("m is not null and (m.status is null or m.status <> 'error')")
    each = members.select("key", "m.name", "m.state", "m.partyName", "m.status", F.posexplode("m.pressReleases").alias("position", "r"))
    return each.select(F.col("key").alias("bioguideId"), F.col("name").alias("memberName"), "state", "partyName", F.col("status").alias("memberStatus"), "position", "r.*")


def house_votes(xml: Column) -> Column:
    """Members' votes of a House roll call: rows without a legislator go."""
    rows = F.from_xml(xml, F.lit(schemas.HOUSE_XML))["vote-data"]["recorded-vote"]
    legal = F.filter(rows, lambda r: r["legislator"].isNotNull())
    return F.transform(legal, lambda r: F.struct(r["legislator"]["_VALUE"].alias("name"), r["legislator"]["_name-id"].alias("bioguideId"), F.lit(None).cast("string").alias("lisMemberId"), r["legislator"]["_party"].alias("party"), r["legislator"]["_state"].alias("state"), r["vote"].alias("voteCast")))


def senate_votes(xml: Column) -> Column:
    rows = F.from_xml(xml, F.lit(schemas.SENATE_XML))["members"]["member"]
    return F.transform(rows, lambda r: F.struct(r["member_full"].alias("name"), F.lit(None).cast("string").alias("bioguideId"), r["lis_member_id"].alias("lisMemberId"), r["party"].alias("party"), r["state"].alias("state"), r["vote_cast"].alias("voteCast")))


def roll_call(url: Column, xml: Column) -> Column:
    """By the host of the source: Senate, House, else no votes."""
    h = text.host(url)
    return F.when(F.contains(h, F.lit("senate.gov")), senate_votes(xml)).when(F.contains(h, F.lit("clerk.house.gov")), house_votes(xml)).otherwise(F.array().cast(f"array<{schemas.MEMBER_VOTE}>"))


def member_list(spark: SparkSession, path: str) -> DataFrame:
    """"Name (ID)" lines; blank lines and those that start with # go."""
    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~F.startswith(line, F.lit("#")))
    return rows.select(F.trim(F.regexp_replace(line, r"\s*\([^)]*\)\s*$", "")).alias("name"), F.nullif(F.trim(F.regexp_extract(line, r"\(([^)]*)\)", 1)), F.lit("")).alias("bioguideId")).where("bioguideId is not null")


def first_source(parts: list[DataFrame], key: str, order: str) -> DataFrame:
    """Rows of each key from the first of several sources that has any."""
    rows = None
    for k, df in enumerate(parts):
        one = df.withColumn("_priority", F.lit(k))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    best = F.min("_priority").over(Window.partitionBy(key))
    return rows.withColumn("_best", best).where("_best = _priority").drop("_best", "_priority").orderBy(key, order)


def read_through(wanted: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(cached rows, keys to fetch)."""
    return cache.join(wanted.select(key).distinct(), key, "left_semi"), wanted.select(key).distinct().join(cache.select(key), key, "left_anti")


#: The path of a release's page, its date, and where its head states a time.
RELEASE = re.compile(r"/media/press-releases/[^/?#]+/?")
LONG_DATE = re.compile(r"[A-Za-z]+\s+\d{1,2},\s+\d{4}")
PUBLISHED = re.compile(r'<meta[^>]*property="article:published_time"[^>]*content="([^"]+)"', re.IGNORECASE)


class _Listing(HTMLParser):
    """Links of anchors to releases on the same host, and the last anchor whose relation holds "next"."""

    def __init__(self) -> None:
        super().__init__()
        self.links: list[str] = []
        self.next: str | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        href = a.get("href") or ""
        if tag == "a" and RELEASE.fullmatch(href):
            self.links.append(href)
        if tag == "a" and href and "next" in (a.get("rel") or "").lower():
            self.next = href


class _Page(HTMLParser):
    """Where a release's parts lie in its page: data of h1, data of the first date div with any, and the body div's inside."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=False)
        self.title, self.date, self.inside = "", "", None
        self._h1 = self._day = False
        self._depth = 0
        self._lines = [0, *(m.end() for m in re.finditer("\n", html))]
        self.feed(html)
        if self._depth:
            self.inside = self.inside[0], len(html)

    def _place(self) -> int:
        line, column = self.getpos()
        return self._lines[line - 1] + column

    def handle_starttag(self, tag: str, attrs: list) -> None:
        classes = dict(attrs).get("class") or ""
        self._h1 |= tag == "h1"
        if tag != "div":
            return
        self._day |= "col-auto" in classes and not self.date
        if self._depth:
            self._depth += 1
        elif "evo-press-release__body" in classes and self.inside is None:
            begin = self._place() + len(self.get_starttag_text())
            self.inside, self._depth = (begin, begin), 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        pass

    def handle_endtag(self, tag: str) -> None:
        self._h1 &= tag != "h1"
        if tag == "div":
            self._day = False
            self._depth = max(0, self._depth - 1)
            if self.inside and not self._depth and self.inside[0] == self.inside[1]:
                self.inside = self.inside[0], self._place()

    def handle_data(self, data: str) -> None:
        self.title += data if self._h1 else ""
        self.date += data if self._day else ""


class _Text(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.feed(unescape(html))
        self.close()

    def handle_data(self, data: str) -> None:
        self.parts += data.split()


def page_parts(html: str | None) -> tuple[str | None, ...]:
    """(title, date, publishedTime, bodyHtml, bodyText) of a release's page; what it lacks is null."""
    html = html or ""
    page, head = _Page(html), PUBLISHED.search(html)
    day = " ".join(page.date.split())
    body = html[slice(*page.inside)] if page.inside else ""
    body = re.sub(r">\s+<", "><", re.sub(r"(?s)<!--.*?-->", "", body).strip())
    body = repair_text(body) or ""
    return repair_text(" ".join(_Text(page.title).parts)) or None, day if LONG_DATE.fullmatch(day) else None, head[1].strip() if head else None, body or None, repair_text(" ".join(_Text(body).parts)) or None


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("title", "date", "publishedTime", "bodyHtml", "bodyText")]))
def _parts(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([page_parts(h) for h in html], columns=["title", "date", "publishedTime", "bodyHtml", "bodyText"])


def release_details(url: Column, html: Column) -> Column:
    """A release from its page: the date is that of the first date div with any text, null if it is no date."""
    p = _parts(html)
    fixed = lambda c: F.nullif(text.repair_artifacts(p[c]), F.lit("")).alias(c)
    return F.struct(url.alias("url"), fixed("title"), p["date"].alias("date"), p["publishedTime"].alias("publishedTime"), fixed("bodyHtml"), fixed("bodyText"))


@F.pandas_udf(T.StructType([T.StructField("links", T.ArrayType(T.StringType())), T.StructField("next", T.StringType())]))
def listing(url: pd.Series, html: pd.Series) -> pd.DataFrame:
    out = []
    for u, h in zip(url, html, strict=True):
        p = _Listing()
        p.feed(h or "")
        out.append((sorted({urljoin(u or "", x) for x in p.links}), urljoin(u or "", p.next) if p.next else None))
    return pd.DataFrame(out, columns=["links", "next"])


def write_by_key(df: DataFrame, path: str, key: str, order: str | None = None) -> None:
    """A folder for each key; the commit protocol makes the write atomic. Rows of a key are sorted if an order is given."""
    rows = df.repartition(F.col(key))
    (rows.sortWithinPartitions(key, order) if order else rows).write.mode("overwrite").partitionBy(key).json(path)


def ensure_collection(spark: SparkSession, name: str, dim: int, recreate: bool = False) -> None:
    """A table of vectors, made if it is missing; recreate drops it first."""
    if recreate:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} (id STRING, key STRING, embedding ARRAY<FLOAT>, model STRING, payload STRING) USING parquet TBLPROPERTIES ('dim' = '{int(dim)}')")
