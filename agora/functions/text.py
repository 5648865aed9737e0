"""Text functions as column expressions: cleaning, labels, lenient numbers and dates.

Python's white space is Unicode's, Java's pattern class is ASCII's; the (?U) flag joins the two. Missing and empty text count
alike where a function says so, and stay apart where it returns null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"
ENDS = r"(?U)^\s+|\s+$"
#: What mis-decoded punctuation looks like, and what it stands for.
ARTIFACTS = {"\u00e2\u20ac\u2122": "\u2019", "\u00e2\u20ac\u0153": "\u201c", "\u00e2\u20ac\x9d": "\u201d", "\u00e2\u20ac\u201c": "\u2013", "\u00e2\u20ac\u201d": "\u2014", "\u00a0": " "}
#: Words in a roll call's result; the positive list is tried first, so that "not passed" counts as passed.
POSITIVE = ("passed", "agreed", "adopted", "confirmed", "ratified", "approved")
NEGATIVE = ("defeated", "rejected", "failed", "not passed", "not agreed")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_or_empty(x: Column | str) -> Column:
    """Trimmed text; null counts as empty."""
    return F.coalesce(F.regexp_replace(_col(x), ENDS, ""), F.lit(""))


def strip_html(x: Column | str) -> Column:
    """Tags go, runs of white space become one space, ends are trimmed; null counts as empty."""
    plain = F.regexp_replace(F.coalesce(_col(x), F.lit("")), "<[^>]+>", "")
    return F.trim(F.regexp_replace(plain, SPACES, " "))


def tags_to_spaces(x: Column | str) -> Column:
    """Each tag becomes a space; nothing else changes."""
    return F.regexp_replace(F.coalesce(_col(x), F.lit("")), "<[^>]+>", " ")


def normalize(x: Column | str) -> Column:
    """Lower case, words joined by single spaces; null counts as empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(x), F.lit(""))), SPACES, " "))


def last_summary(summaries: Column | str) -> Column:
    """The last summary whose text is not blank, without tags; empty if there is none."""
    texts = F.filter(F.transform(_col(summaries), lambda s: F.trim(F.regexp_replace(F.coalesce(s["text"], F.lit("")), "<[^>]+>", ""))), lambda t: t != "")
    return F.when(F.size(texts) > 0, F.element_at(texts, -1)).otherwise("")


def first_summary(summaries: Column | str) -> Column:
    """The text of the first summary that has any, as it stands; null if there is none."""
    return F.get(F.filter(F.transform(_col(summaries), lambda s: s["text"]), lambda t: t.isNotNull() & (t != "")), F.lit(0))


def repair_artifacts(x: Column | str) -> Column:
    out = _col(x)
    for old, new in ARTIFACTS.items():
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def squeeze_html(x: Column | str) -> Column:
    """White space between tags goes."""
    return F.regexp_replace(F.regexp_replace(_col(x), ENDS, ""), r"(?U)>\s+<", "><")


def first_match(x: Column | str, pattern: str) -> Column:
    """The first group of the first match, trimmed; null without a match."""
    found = F.regexp_extract(_col(x), pattern, 1)
    return F.when(F.regexp_like(_col(x), F.lit(pattern)), F.regexp_replace(found, ENDS, ""))


def long_date(x: Column | str) -> Column:
    """Text of the form "February 5, 2026"; null for any other."""
    t = F.regexp_replace(_col(x), ENDS, "")
    return F.when(F.regexp_like(t, F.lit(r"(?U)^[A-Za-z]+\s+\d{1,2},\s+\d{4}$")), t)


def release_time(published: Column | str, date: Column | str) -> Column:
    """The first of the two that can be read: ISO, or one of four day formats; null if neither can. Zones become UTC."""
    tries = []
    for x in (published, date):
        t = F.nullif(F.regexp_replace(_col(x), ENDS, ""), F.lit(""))
        iso = F.when(F.regexp_like(t, F.lit(r"^\d{4}-\d\d-\d\d")), F.try_to_timestamp(t))
        tries.append(iso)
        tries += [F.when(F.regexp_like(t, F.lit(p)), F.try_to_timestamp(t, F.lit(f))) for p, f in ((r"^[A-Za-z]{4,} ", "MMMM d, yyyy"), (r"^[A-Za-z]{3} ", "MMM d, yyyy"), (r"^\d{1,2}-[A-Za-z]{3}-", "d-MMM-yyyy"))]
    return F.coalesce(*tries)


def known_date(x: Column | str) -> Column:
    """Trimmed text; the date of zeros counts as empty, null too."""
    t = text_or_empty(x)
    return F.when(t == "0000-00-00", "").otherwise(t)


def to_int(x: Column | str, fallback: int = 0) -> Column:
    """A whole number, white space around it allowed; anything else gives fallback."""
    return F.coalesce(_whole(_col(x)), F.lit(fallback).cast("bigint"))


def _whole(x: Column) -> Column:
    t = F.regexp_replace(x.cast("string"), ENDS, "")
    return F.when(F.regexp_like(t, F.lit(r"^[+-]?\d+$")), t.try_cast("bigint"))


def at_least_zero(x: Column | str) -> Column:
    return F.greatest(to_int(x), F.lit(0).cast("bigint"))


def truncated(x: Column | str, n: int, mark: str = "...") -> Column:
    """The first n characters and a mark, if the text is longer."""
    return F.when(F.char_length(_col(x)) > n, F.concat(F.substring(_col(x), 1, n), F.lit(mark))).otherwise(_col(x))


def preview(x: Column | str, n: int = 280) -> Column:
    """White space collapsed, n characters; the mark follows if the raw text is longer than n."""
    raw = F.coalesce(_col(x), F.lit(""))
    short = F.substring(F.trim(F.regexp_replace(raw, SPACES, " ")), 1, n)
    return F.when(F.char_length(raw) > n, F.concat(short, F.lit("..."))).otherwise(short)


def vote_outcome(result: Column | str) -> Column:
    t = normalize(result)
    hit = lambda words: F.regexp_like(t, F.lit("|".join(words)))
    return F.when(hit(POSITIVE), "Passed").when(hit(NEGATIVE), "Not Passed").otherwise("Unknown")


def vote_outcome_strict(result: Column | str) -> Column:
    """As vote_outcome, with the negative list first: "not passed" is not passed."""
    t = normalize(result)
    hit = lambda words: F.regexp_like(t, F.lit("|".join(words)))
    return F.when(hit(NEGATIVE), "Not Passed").when(hit(POSITIVE), "Passed").otherwise("Unknown")


def party_bucket(party: Column | str) -> Column:
    t = normalize(party)
    return F.when(F.contains(t, F.lit("republican")), "Republican").when(F.contains(t, F.lit("democrat")), "Democrat").otherwise("Third party")


def party_code(party: Column | str) -> Column:
    p = F.coalesce(_col(party), F.lit(""))
    return F.when(F.contains(p, F.lit("Republican")), "R").when(F.contains(p, F.lit("Democratic")), "D").otherwise("I")


def topic_name(topic: Column | str) -> Column:
    return F.initcap(F.replace(_col(topic), F.lit("_"), F.lit(" ")))


def proposer_values(values: Column | str) -> Column:
    """Trimmed values without blanks; ["Unknown"] if none is left."""
    clean = F.filter(F.transform(_col(values), lambda v: text_or_empty(v.cast("string"))), lambda v: v != "")
    return F.when(F.size(clean) > 0, clean).otherwise(F.array(F.lit("Unknown")))


def host(url: Column | str) -> Column:
    return F.lower(F.try_parse_url(_col(url), F.lit("HOST")))


def last_name_slug(name: Column | str) -> Column:
    """Letters of what stands before the comma, in lower case; null if there are none."""
    return F.nullif(F.regexp_replace(F.lower(F.split_part(F.coalesce(_col(name), F.lit("")), F.lit(","), F.lit(1))), "[^a-z]", ""), F.lit(""))


def fenced_json(x: Column | str) -> Column:
    """What stands in a fence of three back quotes, with or without a language, or else the whole text; trimmed."""
    t = F.regexp_replace(_col(x), ENDS, "")
    inner = F.regexp_extract(t, r"(?s)```(?:json)?(.*?)(?:```|$)", 1)
    return F.when(F.contains(t, F.lit("```")), F.regexp_replace(inner, ENDS, "")).otherwise(t)


def stance_file(name: Column | str) -> Column:
    """(member, source) of a profile's file name; the longer suffix, of voting profiles, is tried first. Null for other names."""
    base = F.element_at(F.split(_col(name), "/"), -1)
    out = F.lit(None).cast("struct<member: string, source: string>")
    for suffix, source in reversed((("_voting_issue_profile.json", "voting"), ("_issue_profile.json", "public"))):
        member = F.trim(F.regexp_replace(base, f"{suffix.replace('.', '[.]')}$", ""))
        out = F.when(F.endswith(base, F.lit(suffix)), F.when(member != "", F.struct(member.alias("member"), F.lit(source).alias("source")))).otherwise(out)
    return out


def response_text(payload: Column | str) -> Column:
    """The text of a model's answer in JSON: output_text, or else all output[].content[].text together; empty without any."""
    shape = "struct<output_text: string, output: array<struct<content: array<struct<text: string>>>>>"
    p = F.from_json(_col(payload), shape)
    parts = F.flatten(F.transform(p["output"], lambda o: F.transform(F.coalesce(o["content"], F.array().cast("array<struct<text:string>>")), lambda c: F.coalesce(c["text"], F.lit("")))))
    return F.coalesce(F.nullif(p["output_text"], F.lit("")), F.array_join(parts, ""), F.lit(""))


def utc_now(form: str = "iso") -> Column:
    """The time of the query in UTC as text: iso (+00:00), zulu (Z, whole seconds) or stamp (for names of files)."""
    pattern = {"iso": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'", "zulu": "yyyy-MM-dd'T'HH:mm:ss'Z'", "stamp": "yyyyMMdd'T'HHmmss"}[form]
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), pattern)
