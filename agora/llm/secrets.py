"""Secret scans: patterns of credentials, and character Markov models for those that no pattern knows.

Two models of character pairs, one of random strings and one of ordinary identifiers, are trained from labelled samples. A
token is reported as kind "random" if the log-likelihood ratio of the models says so by MARGIN and it meets no other span.
Tokens of letters alone are scored as any other.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm import tokens
from agora.llm.shared import bounded

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(rb"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
HEX_LONG = re.compile(rb"[0-9a-f]{24}")
#: Candidates for the models: all long runs of these characters, letters or digits alone among them.
TOKEN = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
#: A token is random if the ratio reaches MARGIN and SLOPE for each of its characters.
MARGIN, SLOPE = 4.0, 0.4
SAMPLES = 6000
_CODE = np.zeros(256, np.int64)
_CODE[list(ALPHABET.encode())] = np.arange(1, len(ALPHABET) + 1)
SHAPE = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def labelled_samples(n: int = SAMPLES, seed: int = 11) -> list[tuple[str, int]]:
    """n strings by rule, one half random (1: keys in hex, base 64 and alphanumerics), one half identifiers (0: compound words,
    paths, dates, numbered names and rulers). n bounds the samples."""
    rng = random.Random(seed)
    onset, rhyme = ["b", "br", "c", "ch", "d", "f", "g", "h", "j", "l", "m", "n", "p", "pr", "qu", "r", "s", "st", "t", "th", "tr", "v", "w", "", "bl", "cl", "fr", "gl", "gr", "k", "kl", "ph", "pl", "sch", "sh", "sp", "str", "x", "y", "z"], ["a", "an", "ar", "e", "ed", "en", "er", "es", "i", "in", "ing", "ion", "ity", "ly", "o", "on", "or", "ou", "re", "ti", "u", "und", "al", "as", "ch", "eit", "eau", "el", "ent", "heit", "ial", "ich", "ie", "ist", "ive", "keit", "le", "ment", "os", "ous", "ow", "per", "ry", "st", "ung", "ur", "us", "y"]
    word = lambda: "".join(rng.choice(onset) + rng.choice(rhyme) for _ in range(rng.randint(1, 3)))
    out = []
    for k in range(n // 2):
        letters = (string.hexdigits[:16], string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, string.ascii_uppercase + string.digits)[k % 4]
        out.append(("".join(rng.choice(letters) for _ in range(rng.randint(20, 64))), 1))
        words = [word() for _ in range(rng.randint(3, 6))]
        join = ("_".join, "-".join, "".join, "/".join, lambda w: "".join(x.title() for x in w), lambda w: "_".join(w).upper(), lambda w: "_".join(w) + str(rng.randint(1, 2030)), lambda w: f"20{rng.randint(10, 30)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}_" + "-".join(w))[k % 8]
        rule = rng.choice(ALPHABET) * rng.randint(20, 64)  # a ruler or a blacked-out value
        out.append((rule if k % 9 == 8 else join(words), 0))
    return out


def train(samples: Iterable[tuple[str, int]]) -> np.ndarray:
    """Log-likelihood ratios (random over ordinary) of each pair of characters, with add-one smoothing; row and column 0 stand
    for the ends and for other characters."""
    counts = np.ones((2, len(ALPHABET) + 1, len(ALPHABET) + 1))
    for s, label in samples:
        c = np.concatenate([[0], _CODE[np.frombuffer(s.encode(), np.uint8)], [0]])
        np.add.at(counts[int(label)], (c[:-1], c[1:]), 1)
    p = np.log(counts / counts.sum(2, keepdims=True))
    return p[1] - p[0]


def score(token: bytes, model: np.ndarray) -> float:
    c = np.concatenate([[0], _CODE[np.frombuffer(token, np.uint8)], [0]])
    return float(model[c[:-1], c[1:]].sum())


def find(data: bytes, model: np.ndarray) -> list[tuple[int, str, int]]:
    """(start, kind, end) in bytes of one UTF-8 text, by start and kind."""
    out = []
    for m in ASSIGN.finditer(data):
        if m.end(2) - m.start(2) >= 6:
            out.append((m.start(), "assign", m.end()))
    for m in ACCESS.finditer(data):
        if m.end() - m.start() >= 20:
            out.append((m.start(), "access", m.end()))
    if HEX_LONG.search(data):
        out += [(m.start(), "hex", m.end()) for m in HEX.finditer(data) if m.end() - m.start() >= 24]
    apart, at = sorted((a, b) for a, _, b in out), 0
    for m in TOKEN.finditer(data):
        while at < len(apart) and apart[at][1] <= m.start():
            at += 1
        if not (at < len(apart) and apart[at][0] < m.end()) and score(m.group(), model) >= MARGIN + SLOPE * len(m.group()):
            out.append((m.start(), "random", m.end()))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def in_points(data: bytes, spans: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
    """Spans in code points instead of bytes."""
    if not spans or data.isascii():
        return spans
    run = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(int(run[a]), k, int(run[b])) for a, k, b in spans]


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes]:
    """UTF-8 bytes of each text, null as empty."""
    buf, offs = tokens.column(batch.column(name))
    raw = memoryview(buf)
    for a, b in zip(offs[:-1], offs[1:], strict=True):
        yield bytes(raw[a:b])


def scan(docs: DataFrame, samples: Iterable[tuple[str, int]] | None = None) -> DataFrame:
    """One row for each row of docs (doc_id, text): counts by kind, base_sha256 over the pattern spans, spans of all kinds.

    A null text counts as empty: no spans, the digest of nothing. Assignments count if their value has 6 characters or more,
    access keys from 20, hex runs from 24. Repeated rows come back as often as they came; a null doc_id stays null; other
    columns are not read. An empty table gives no rows. samples: labelled (string, 1 if random), else labelled_samples().
    """
    bounded(docs.sparkSession)
    model = train(labelled_samples() if samples is None else samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for data in texts(batch):
                spans = in_points(data, find(data, model))
                base = [s for s in spans if s[1] != "random"]
                for c, kind in zip(cols, KINDS, strict=False):
                    c.append(sum(k == kind for _, k, _ in spans))
                cols[4].append(hashlib.sha256(joined(base).encode()).hexdigest())
                cols[5].append(joined(spans))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {SHAPE}")


def redact(docs: DataFrame, samples: Iterable[tuple[str, int]] | None = None) -> DataFrame:
    """docs with each found span replaced by its kind in brackets; null texts stay null, all columns stay."""
    bounded(docs.sparkSession)
    model = train(labelled_samples() if samples is None else samples)
    shape = docs.schema
    at = shape.names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = []
            for data, valid in zip(texts(batch), batch.column(at).is_valid().to_pylist(), strict=True):
                out, last = [], 0
                for a, k, b in find(data, model):
                    if a >= last:
                        out += [data[last:a], f"[{k.upper()}]".encode()]
                    last = max(last, b)
                clean.append((b"".join(out) + data[last:]).decode() if valid else None)
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    return docs.mapInArrow(run, shape)
