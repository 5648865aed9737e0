"""Identities: one canonical form of each key, and the digests that name rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agora.functions.text import text_or_empty


def bill_key(congress: Column, kind: Column, number: Column, upper: bool = False) -> Column:
    """congress-type-number, the type in lower case (or upper); null if any part is missing or blank."""
    case = F.upper if upper else F.lower
    parts = [text_or_empty(congress.cast("string")), case(text_or_empty(kind)), text_or_empty(number.cast("string"))]
    return F.when((parts[0] != "") & (parts[1] != "") & (parts[2] != ""), F.concat_ws("-", *parts))


def parse_bill_key(key: Column) -> Column:
    """(congress int, type in upper case, number); null unless there are three parts and the first is a number."""
    p = F.split(key, "-")
    return F.when((F.size(p) == 3) & F.regexp_like(p[0], F.lit(r"^\s*\d+\s*$")), F.struct(F.trim(p[0]).cast("int").alias("congress"), F.upper(p[1]).alias("type"), p[2].alias("number")))


def vote_key(*parts: Column) -> Column:
    """chamber|congress|session|roll|recordedAt; missing parts count as empty."""
    return F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def sha1_key(*parts: Column) -> Column:
    """SHA-1 of the trimmed parts joined by a double bar; missing parts count as empty."""
    return F.sha1(F.concat_ws("||", *(text_or_empty(p.cast("string")) for p in parts)))


def release_slug(date: Column, title: Column) -> Column:
    """pr-date-title, of the title 20 characters in lower case with hyphens; null without a date or title."""
    short = F.replace(F.lower(F.substring(title, 1, 20)), F.lit(" "), F.lit("-"))
    return F.when((F.coalesce(date, F.lit("")) != "") & (F.coalesce(title, F.lit("")) != ""), F.concat(F.lit("pr-"), date, F.lit("-"), short))
