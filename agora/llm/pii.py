"""Personal data: patterns, and terms that give the protected values away.

Information-theoretic sanitisation: e-mail addresses, IP addresses, card and phone numbers are protected entities. Over the
whole corpus, the number of documents that hold an entity, that hold a term, and in which the term stands within REACH words of
the entity give the pointwise mutual information of the two. A term that leaves at most 1 - DISCLOSURE of an entity's own
information open discloses it: it becomes a span of kind "term". The share of a term's documents in which it meets the entity
is drawn towards the entity's own share by PRIOR documents, so that one meeting counts, but for less than many do.
A document that holds an entity loses the terms that disclose it wherever they stand in its text, not only near the entity.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.secrets import in_points, joined, texts
from agora.llm.shared import bounded, cut, small

KINDS = ("email", "ip", "card", "phone", "term")
DOMAIN = re.compile(rb"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits matches from its first digit or not at all, so that later digits need no trial.
IP = re.compile(rb"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(rb"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(rb"[^\x20\x09-\x0D]+")
REACH, DISCLOSURE, PRIOR = 5, 0.9, 0.5
#: Distinct terms that a task counts before it hands partial counts on.
HELD = 200_000


def luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        if k % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(x: bytes) -> bytes:
    return bytes(c for c in x if 48 <= c <= 57)


def find(data: bytes) -> list[tuple[int, str, int]]:
    """(start, kind, end) in bytes of one UTF-8 text, by kind and start."""
    out, last = [], 0
    at = data.find(b"@")
    while at >= 0:
        if (m := DOMAIN.match(data, at)) and at > last and data[at - 1] in _LOCAL:
            a = at
            while a > last and data[a - 1] in _LOCAL:
                a -= 1
            out.append((a, "email", m.end()))
            last = m.end()
        at = data.find(b"@", at + 1)
    for m in IP.finditer(data):
        if all(len(p) <= 3 and int(p or b"0") <= 255 for p in (x.lstrip(b"0") for x in m.group().split(b"."))):
            out.append((m.start(), "ip", m.end()))
    for m in CARD.finditer(data):
        if m.end() - m.start() <= 37 and 13 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), "card", m.end()))
    for m in PHONE.finditer(data):
        if 9 <= len(_digits(m.group())) <= 15:
            out.append((m.start(), "phone", m.end()))
    return out


def _fold(term: bytes) -> bytes:
    return term.lower().strip(b".,;:!?\"'()[]")


def _entities(data: bytes, spans: list[tuple[int, str, int]]) -> list[bytes]:
    """The protected value of each span, by which documents hold the same entity."""
    return [kind.encode() + b":" + (data[a:b].lower() if kind in ("email", "ip") else _digits(data[a:b])) for a, kind, b in spans]


def _apart(spans: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """What spans cover, as intervals in order that do not meet."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for a, _, b in spans):
        if out and a < out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _words(data: bytes, spans: list[tuple[int, str, int]]) -> list[tuple[int, int, bytes]]:
    """(start, end, term) of the words that can be terms: of two bytes or more, and apart from all spans."""
    out, at, apart = [], 0, _apart(spans)
    for m in TERM.finditer(data):
        while at < len(apart) and apart[at][1] <= m.start():
            at += 1
        if len(term := _fold(m.group())) > 1 and not (at < len(apart) and apart[at][0] < m.end()):
            out.append((m.start(), m.end(), term))
    return out


def _near(data: bytes, spans: list[tuple[int, str, int]]) -> set[tuple[bytes, bytes]]:
    """Each entity of the text with each term within REACH words of it; terms that meet a span are left out."""
    out: set[tuple[bytes, bytes]] = set()
    words = [(m.start(), m.end()) for m in TERM.finditer(data)]
    ends, apart = [e for _, e in words], _apart(spans)
    last = [b for _, b in apart]
    for (a, _, b), entity in zip(spans, _entities(data, spans), strict=True):
        first = bisect_right(ends, a)
        after = first
        while after < len(words) and words[after][0] < b:
            after += 1
        for s, e in words[max(0, first - REACH) : first] + words[after : after + REACH]:
            term = _fold(data[s:e])
            at = bisect_right(last, s)
            if len(term) > 1 and not (at < len(apart) and apart[at][0] < e):
                out.add((entity, term))
    return out


def _key(x: bytes) -> bytes:
    return hashlib.blake2b(x, digest_size=16).digest()


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data in texts(batch):
            spans = find(data)
            met = [{"e": _key(e), "t": _key(t)} for e, t in sorted(_near(data, spans))] if spans else []
            rows.append((in_points(data, spans), met, sorted({_key(e) for e in _entities(data, spans)}), data.decode() if spans else None))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), *(pa.array([sum(k == kind for _, k, _ in r[0]) for r in rows], pa.int64()) for kind in KINDS[:4]), pa.array([joined(r[0]) for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.struct([("e", pa.binary()), ("t", pa.binary())]))), pa.array([r[2] for r in rows], pa.list_(pa.binary())), pa.array([r[3] for r in rows], pa.string())],
            names=["row", *(f"n_{k}" for k in KINDS[:4]), "base", "met", "held", "text"],
        )


BASE_SHAPE = "row struct<doc_id: bigint, row: bigint>, n_email long, n_ip long, n_card long, n_phone long, base string, met array<struct<e: binary, t: binary>>, held array<binary>, text string"


def _document_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial numbers of documents by term."""
    held: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([_key(t) for t in held], pa.binary()), pa.array(list(held.values()), pa.int64())], names=["t", "df"])
        held.clear()
        return out

    for batch in batches:
        for data in texts(batch):
            held.update({_fold(w) for w in set(data.split())})
            if len(held) > HELD:
                yield flush()
    yield flush()


def _all_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, t): the terms of each text, wherever they stand."""
    for batch in batches:
        rows, found = [], []
        for row, data in zip(batch.column("row").to_pylist(), texts(batch), strict=True):
            terms = {t for _, _, t in _words(data, find(data))}
            rows += [row] * len(terms)
            found += [_key(t) for t in terms]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(found, pa.binary())], names=["row", "t"])


def marks(data: bytes, terms: set[bytes]) -> list[tuple[int, str, int]]:
    """(start, kind, end) in bytes: the entities of one text by kind and start, then each word whose key is among terms."""
    spans = find(data)
    return spans + [(s, "term", e) for s, e, t in _words(data, spans) if _key(t) in terms] if terms else spans


def clean(data: bytes, spans: list[tuple[int, str, int]]) -> bytes:
    """data with each span generalised to its kind in brackets; of spans that overlap, the first names what all of them covered."""
    out, last = [], 0
    for a, kind, b in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]))):
        if a >= last:
            out += [data[last:a], f"[{kind.upper()}]".encode()]
        last = max(last, b)
    return b"".join(out) + data[last:]


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for data, terms in zip(texts(batch), batch.column("terms").to_pylist(), strict=True):
            spans = marks(data, set(terms or ()))
            rows.append((sum(k == "term" for _, k, _ in spans), joined(in_points(data, spans)), clean(data, spans).decode()))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["row", "n_term", "spans", "clean"])


def _found(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, counts, base, ...) of each of rows (row, doc_id, text), and (row, n_term, spans, clean) of those that hold an
    entity. row is unique."""
    bounded(rows.sparkSession)
    told_by = rows.select(F.struct("doc_id", "row").alias("row"), "text").mapInArrow(_base, BASE_SHAPE)
    found = cut(told_by.select("row.doc_id", "row.row", *told_by.columns[1:]), "pii")
    holding = found.where("text is not null")
    met = holding.select("row", F.explode("met").alias("m")).select("row", "m.e", "m.t")
    held = holding.select("row", F.explode("held").alias("e"))
    both = met.groupBy("e", "t").agg(F.count("*").alias("both"))
    alone = held.groupBy("e").agg(F.count("*").alias("with_e"))
    n = found.count()
    share = F.col("with_e") / F.lit(float(max(n, 1)))
    told = (F.col("both") + PRIOR * share) / (F.col("df") + PRIOR)
    discloses = (share < 1) & (F.log2(told / share) >= -DISCLOSURE * F.log2(share))
    # Documents that hold an entity are few: a term that stands in too many of them alone need not be counted in all.
    here = holding.select("text").mapInArrow(_document_counts, "t binary, df long").groupBy("t").agg(F.sum("df").alias("df"))
    pairs = cut(both.join(alone, "e").join(here, "t").where(discloses).drop("df"), "meetings")
    counts = cut(_counts_of(rows, pairs.select("t").distinct()), "counts")
    disclosing = cut(pairs.join(counts, "t").where(discloses).select("e", "t"), "disclosing")
    # A term goes from every place in the documents that hold its entity. Terms that disclose are rare, so these joins stay small.
    stand = holding.select("row", "text").mapInArrow(_all_words, "row long, t binary").join(small(disclosing), "t")
    terms = stand.join(held, ["row", "e"], "left_semi").groupBy("row").agg(F.collect_set("t").alias("terms"))
    marked = holding.select("row", "text").join(terms, "row", "left").mapInArrow(_marked, "row long, n_term long, spans string, clean string")
    return found, marked


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.monotonically_increasing_id().alias("row"))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): n_email, n_ip, n_card, n_phone, n_term, base_sha256 over the pattern spans,
    spans of all kinds by kind and start: what sanitise() replaces.

    A null text counts as empty: no spans, the digest of nothing. Repeated rows come back as often as they came, and count as
    documents each; a null doc_id stays null. Documents without a protected entity get no term spans. Other columns are not
    read. An empty table gives no rows.
    """
    found, marked = _found(_rows(docs))
    out = found.drop("met", "held", "text").join(marked.drop("clean"), "row", "left")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.coalesce("n_term", F.lit(0)).cast("long").alias("n_term"), F.sha2("base", 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with the spans of scan() replaced by their kinds in brackets, entities and terms alike; all other columns stay.

    Null texts stay null; documents without a protected entity stay as they are. docs is written once to the shared folder.
    """
    kept = cut(docs.select(F.struct(*docs.columns).alias("doc"), F.monotonically_increasing_id().alias("row")), "unsanitised")
    _, marked = _found(kept.select(F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").cast("string").alias("text"), "row"))
    out = kept.join(marked.select("row", "clean"), "row", "left")
    text = F.coalesce("clean", F.col("doc.text")).cast(docs.schema["text"].dataType).alias("text")
    return out.select(*(text if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns))


def _counts_of(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(t, df) of the terms over all documents: counted per task and, if the terms are few, filtered before the shuffle."""
    return rows.select("text").mapInArrow(_document_counts, "t binary, df long").join(small(terms), "t", "left_semi").groupBy("t").agg(F.sum("df").alias("df"))
