"""Reshapes of nested records: votes, releases, members, bills, payloads, prompts and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from agora import schemas
from agora.functions import keys, text

#: Hues go round by the golden angle, in degrees.
GOLDEN_ANGLE = 137.508
PLACEHOLDER = "No summary is available for this topic."


def _or_empty(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def vote_record(vote: Column, legislation: Column) -> Column:
    """A vote with the bill that it was on; without legislation the bill's fields and its key are null."""
    key = keys.bill_key(legislation["congress"], legislation["type"], legislation["number"])
    return F.struct(vote["rollCall"].alias("rollCall"), vote["date"].alias("date"), vote["memberVote"].alias("vote"), vote["result"].alias("result"), key.alias("billId"), legislation["title"].alias("title"))


def release_record(r: Column) -> Column:
    return F.struct(keys.release_slug(r["date"], r["title"]).alias("id"), _or_empty(r["title"]).alias("title"), _or_empty(r["date"]).alias("date"), _or_empty(r["url"]).alias("url"), _or_empty(r["bodyText"]).alias("body"))


def member_metadata(m: Column) -> Column:
    """Names parted at the comma, a party code, the chamber of the first term, and an address for members of the House."""
    parts = F.split(_or_empty(m["name"]), ", ")
    last, first = _or_empty(F.get(parts, F.lit(0))), _or_empty(F.get(parts, F.lit(1)))
    chamber = _or_empty(F.get(m["terms"], F.lit(0))["chamber"])
    url = F.when(chamber == "House of Representatives", F.concat(F.lit("https://"), F.lower(last), F.lit(".house.gov"))).otherwise("")
    known = F.struct(
        m["bioguideId"].alias("bioguideId"), _or_empty(m["name"]).alias("name"), first.alias("firstName"), last.alias("lastName"), _or_empty(m["state"]).alias("state"), _or_empty(m["district"]).alias("district"),
        _or_empty(m["partyName"]).alias("party"), text.party_code(m["partyName"]).alias("partyCode"), chamber.alias("chamber"), F.lit(True).alias("currentMember"), url.alias("profileUrl"), _or_empty(m["imageUrl"]).alias("imageUrl"),
    )
    return known


def unknown_member(ident: Column) -> Column:
    """What stands for a member of whom nothing is known."""
    blank = [F.lit("").alias(n) for n in ("firstName", "lastName", "state", "district", "party", "partyCode", "chamber")]
    return F.struct(ident.alias("bioguideId"), F.lit("Unknown").alias("name"), *blank, F.lit(False).alias("currentMember"), F.lit("").alias("profileUrl"), F.lit("").alias("imageUrl"))


def bill_record(b: Column) -> Column:
    """Names of subjects that are not blank; no co-sponsors count as 0."""
    names = F.filter(F.transform(F.coalesce(b["subjects"], F.array().cast("array<struct<name: string>>")), lambda s: _or_empty(s["name"])), lambda n: n != "")
    return F.struct(b["congress"].alias("congress"), b["type"].alias("type"), b["number"].alias("number"), b["title"].alias("title"), names.alias("subjects"), F.coalesce(b["cosponsors"], F.lit(0)).alias("cosponsors"))


#: The fields of a person, as the source names them and as they are kept.
PERSON = {"people_id": "peopleId", "name": "name", "first_name": "firstName", "middle_name": "middleName", "last_name": "lastName", "suffix": "suffix", "party": "party", "role": "role", "district": "district", "state": "state", "state_id": "stateId"}


def person(p: Column, fields: tuple[str, ...] = tuple(PERSON)) -> Column:
    """The fields of a person that are kept, as they stand."""
    return F.struct(*(p[c].alias(PERSON[c]) for c in fields))


def sponsors(listed: Column) -> Column:
    """Sponsors of a state bill; null entries go. Whether a committee sponsors is told by a number, 0 if it is none."""
    return F.transform(F.filter(listed, lambda s: s.isNotNull()), lambda s: F.struct(
        *(s[c].alias(PERSON[c]) for c in ("people_id", "name", "first_name", "last_name", "party", "role", "district")), s["sponsor_type_id"].alias("sponsorTypeId"), s["sponsor_order"].alias("sponsorOrder"),
        (text.to_int(s["committee_sponsor"].cast("string")) != 0).alias("committeeSponsor"),
    ))


def _labelled(*parts: tuple[str, Column]) -> Column:
    """"Label: text" for each text that is not empty, with a blank line between."""
    return F.array_join(F.array_compact(F.array(*(F.when(_or_empty(x) != "", F.concat(F.lit(f"{label}: "), x)) for label, x in parts))), "\n\n")


def bill_text(title: Column, summary: Column, subjects: Column, vote: Column) -> Column:
    """What of a bill is embedded; tags of the summary go."""
    return _labelled(("Title", title), ("Summary", text.strip_html(summary)), ("Topics", F.array_join(subjects, ", ")), ("Vote", vote))


def release_text(title: Column, body: Column) -> Column:
    return _labelled(("Title", title), ("Content", body))


def embedding_candidate(title: Column, body: Column, most: int = 24_000) -> Column:
    """(text, textSource, bodyCharCount): the body if it has 1 to most characters, else the title, else null."""
    t, b = text.text_or_empty(title), text.text_or_empty(body)
    n = F.char_length(b)
    row = lambda x, source: F.struct(x.alias("text"), F.lit(source).alias("textSource"), n.alias("bodyCharCount"))
    return F.when(n.between(1, most), row(b, "bodyText")).when(t != "", row(t, "title_fallback"))


def vote_display(m: Column) -> Column:
    """The columns of a roll call's table."""
    return F.struct(*(m[c].alias(c) for c in ("name", "party", "state", "voteCast", "bioguideId", "lisMemberId")))


def _of_member(m: Column) -> list[Column]:
    return [m["bioguideId"].alias("bioguideId"), m["name"].alias("memberName"), m["party"].alias("party"), m["state"].alias("state")]


def bill_payload(b: Column, m: Column) -> Column:
    """What a bill's vector carries: the bill without tags, the member's vote, the member."""
    kept = [b[c].alias(c) for c in ("billId", "congress", "type", "number", "title")] + [text.strip_html(b["summary"]).alias("summary")]
    return F.struct(*kept, *(b[c].alias(c) for c in ("subjects", "cosponsors", "url", "memberVote", "voteDate", "rollCall", "session", "result")), *_of_member(m))


def release_payload(r: Column, m: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(*(r[c].alias(c) for c in ("id", "title", "date", "publishedTime", "url", "bodyText")), F.coalesce(r["topics"], none).alias("topics"), F.coalesce(r["relatedBills"], none).alias("relatedBills"), *_of_member(m))


def state_vote_event(v: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """A state roll call: ids as they stand, passed as a truth value, the stated totals (0 where missing), the members and what
    their votes add up to."""
    total = lambda c: text.to_int(v[c].cast("string"))
    stated = F.struct(total("yea").alias("yea"), total("nay").alias("nay"), total("nv").alias("notVoting"), total("absent").alias("absent"), total("total").alias("total"))
    return F.struct(
        v["roll_call_id"].alias("rollCallId"), v["date"].alias("date"), _or_empty(v["desc"]).alias("description"), v["chamber"].alias("chamber"), (text.to_int(v["passed"].cast("string")) != 0).alias("passed"),
        stated.alias("totals"), vote_totals(v["votes"], table).alias("voteCountsFromMembers"), F.size(v["votes"]).alias("members"),
    )


def legacy_profile(raw: Column) -> Column:
    """A profile in JSON as a map of topic to summary and evidence: a topic that is only text is its summary, with evidence 0."""
    each = F.from_json(raw, "map<string, string>")
    held = "struct<summary: string, evidence: int>"

    def entry(v: Column) -> Column:
        whole = F.from_json(v, held)
        return F.when(F.startswith(F.ltrim(v), F.lit("{")), F.struct(_or_empty(whole["summary"]).alias("summary"), F.coalesce(whole["evidence"], F.lit(0)).alias("evidence"))).otherwise(F.struct(_or_empty(v).alias("summary"), F.lit(0).alias("evidence")))

    return F.transform_values(each, lambda k, v: entry(v))


def stance_prompt(topic: Column, first: Column, second: Column) -> Column:
    """What a model is asked about two summaries of one topic: to compare them, in Markdown."""
    return F.concat_ws("\n", F.concat(F.lit("Topic: "), text.topic_name(topic)), F.concat(F.lit("Votes say: "), F.coalesce(F.nullif(first, F.lit("")), F.lit("nothing"))), F.concat(F.lit("Releases say: "), F.coalesce(F.nullif(second, F.lit("")), F.lit("nothing"))), F.lit("Compare the two in Markdown: agreement, tension, evidence."))


def step_prompt(topics: tuple[str, ...], title: Column, outcome: Column, summary: Column, most: int = 4000) -> Column:
    """What a model is asked about one vote: the topics, then the bill and how the member voted."""
    return F.concat_ws("\n", F.lit("Topics: " + ", ".join(topics)), F.concat(F.lit("Bill: "), _or_empty(title)), F.concat(F.lit("Vote: "), _or_empty(outcome)), F.concat(F.lit("Summary: "), F.substring(text.strip_html(summary), 1, most)))


def vote_totals(members: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """Counts by bucket from an array of members' votes, in the array's own row."""
    from agora.operators.counts import bucket

    names = F.transform(members, lambda m: bucket(m["voteText"], table))
    count = lambda k: F.size(F.filter(names, lambda n: n == F.lit(k)))
    return F.struct(*(count(k).alias(k) for k in (*table, "other")))


def topic_candidate(topic: Column, summary: Column, evidence: Column, include_empty: bool = False) -> Column:
    """A topic's text and evidence of 0 at least; without a summary a placeholder, or null if empty ones are not wanted."""
    s = text.text_or_empty(summary)
    chosen = F.when(s != "", s).otherwise(F.lit(PLACEHOLDER) if include_empty else F.lit(None).cast("string"))
    return F.when(chosen.isNotNull(), F.struct(topic.alias("topic"), chosen.alias("text"), text.at_least_zero(evidence.cast("string")).alias("evidence")))


def bill_search_text(title: Column, ident: Column, summaries: Column, votes: Column) -> Column:
    """Title, id, the first summary's 900 characters, and questions and results of the first five votes."""
    said = F.array_join(F.transform(F.slice(votes, 1, 5), lambda v: F.concat_ws(" ", v["question"], v["result"], v["chamber"])), " ")
    return text.normalize(F.concat_ws(" ", title, ident, F.substring(F.get(summaries, F.lit(0))["text"], 1, 900), said))


def profile_search_text(identity: list[Column], profile: Column) -> Column:
    """Identity, then each topic in the fixed order with 240 characters of its summary; profile is a map of topics to text."""
    topics = F.transform(F.array(*(F.lit(t) for t in schemas.TOPICS)), lambda t: F.concat_ws(" ", F.replace(t, F.lit("_"), F.lit(" ")), F.substring(F.try_element_at(profile, t), 1, 240)))
    return text.normalize(F.concat_ws(" ", *identity, F.array_join(topics, " ")))


def member_label(name: Column, party: Column, state: Column, ident: Column) -> Column:
    dash = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("-"))
    return F.format_string("%s (%s, %s) [%s]", F.coalesce(F.nullif(name, F.lit("")), dash(ident)), dash(party), dash(state), dash(ident))


def wrapped(x: Column, width: int = 56, lines: int = 3) -> Column:
    """Words in lines of width characters at most, of which the first few stay; a longer word has a line for itself."""
    words = F.filter(F.split(_or_empty(x), r"(?U)\s+"), lambda w: w != "")
    start = F.array().cast("array<string>")
    last = lambda a: F.coalesce(F.try_element_at(a, F.size(a)), F.lit(""))
    fits = lambda a, w: (F.size(a) > 0) & (F.char_length(last(a)) + F.char_length(w) + 1 <= width)
    joined = F.aggregate(words, start, lambda a, w: F.when(fits(a, w), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.concat(last(a), F.lit(" "), w)))).otherwise(F.concat(a, F.array(w))))
    return F.array_join(F.slice(joined, 1, lines), "<br>")


def number_or_dash(x: Column, digits: int = 3) -> Column:
    return F.when(x.isNull() | F.isnan(x.cast("double")), "-").otherwise(F.format_string(f"%.{digits}f", x.cast("double")))


def style(rank: Column, symbols: tuple[str, ...]) -> Column:
    """A symbol by turns and a hue by the golden angle, for ranks from 0."""
    return F.struct(F.get(F.array(*(F.lit(s) for s in symbols)), (rank % len(symbols)).cast("int")).alias("symbol"), F.pmod(rank * F.lit(GOLDEN_ANGLE), F.lit(360.0)).alias("hue"))


def fold_prompt(profile: Column, title: Column, date: Column, body: Column, most: int = 4000) -> Column:
    """What a model is asked: the whole profile so far as JSON, then the next document."""
    return F.concat_ws("\n", F.concat(F.lit("Profile: "), F.to_json(profile)), F.concat(F.lit("Title: "), _or_empty(title)), F.concat(F.lit("Date: "), _or_empty(date)), F.concat(F.lit("Text: "), F.substring(_or_empty(body), 1, most)))


def name_match(name: Column, asked: str) -> Column:
    """Either holds the other, in any case; blank names match nothing."""
    n, a = text.normalize(name), " ".join(asked.lower().split())
    return (n != "") & bool(a) & (F.contains(n, F.lit(a)) | F.contains(F.lit(a), n))


def terms_of(raw: Column) -> Column:
    """Terms from JSON that is a list, an object with item, or one term; anything else is no terms."""
    kind = f"array<{schemas.TERM}>"
    listed, held = F.from_json(raw, kind), F.from_json(raw, f"struct<item: {kind}>")["item"]
    return F.when(F.startswith(F.ltrim(raw), F.lit("[")), listed).when(held.isNotNull(), held).when(F.from_json(raw, schemas.TERM)["chamber"].isNotNull(), F.array(F.from_json(raw, schemas.TERM))).otherwise(F.array().cast(kind))


def current_house_member(terms: Column) -> Column:
    return F.coalesce(F.exists(terms, lambda t: (t["chamber"] == "House of Representatives") & t["endYear"].isNull()), F.lit(False))


def is_amendment(kind: Column) -> Column:
    return F.coalesce(F.upper(kind).isin("HAMDT", "SAMDT"), F.lit(False))


def in_window(day: Column, first: str, last: str) -> Column:
    """Between two days; what is missing or no day passes."""
    return F.coalesce(F.try_to_date(day).between(F.lit(first).cast("date"), F.lit(last).cast("date")), F.lit(True))


def visible(x: Column, chosen: list) -> Column:
    """Among the chosen; an empty choice shows nothing."""
    return F.coalesce(x.isin(*chosen), F.lit(False)) if chosen else F.lit(False)
