"""Quality rules by repetition coverage: the share of a text's characters inside n-grams and lines that occur again.

Rolling hashes of several n-gram lengths are computed with numpy over many texts at once. A document fails the base rule if
it has fewer than 50 words, or if over half of its words lie in three-word windows that occur twice or more; it fails the
coverage rules if repeated n-grams or lines hold over LIMITS of its characters, or symbols stand too thick.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.llm import tokens
from agora.llm.shared import bounded

MIN_WORDS, WINDOW = 50, 3
#: Of 100 characters in words, those inside repeated n-grams, by n; those in repeated lines; symbols for each 100 words.
LIMITS = {5: 45, 8: 40, 10: 35}
LINE_LIMIT, SYMBOL_LIMIT = 45, 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *(f"chars_rep_{n}" for n in LIMITS), "chars_dup_lines")


def _per_text(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(values)])
    return run[at[1:]] - run[at[:-1]]


def repeated(h: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """For each word, whether it lies in a run of n words that its text holds twice or more, the first included."""
    g = tokens.grams(h, n)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    inside = text[: len(g)] == text[n - 1 :] if len(g) else np.zeros(0, bool)
    where = np.flatnonzero(inside)
    key = tokens.mix(g[where] + text[where].astype(np.uint64) * tokens.U(tokens.BASE))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = where[order[np.flatnonzero(np.concatenate([same, [False]]) | np.concatenate([[False], same]))]] if len(where) else where
    step = np.zeros(len(h) + 1, np.int64)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(arr: pa.Array) -> dict[str, np.ndarray]:
    """COLUMNS for each text; null counts as empty."""
    buf, offs = tokens.column(arr)
    buf = buf[offs[0] : offs[-1]]
    offs = offs - offs[0]
    s, e = tokens.edges(buf, offs)
    at = np.searchsorted(s, offs)
    h = tokens.spans_hash(buf, s, e)
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    size = chars[e] - chars[s]
    out = {"n_words": np.diff(at), "word_chars": _per_text(size, at), "n_symbols": _per_text(SYMBOLS[buf], offs)}

    cuts = np.flatnonzero(buf == 10)
    ls = np.sort(np.concatenate([offs[:-1], cuts + 1]))
    le = np.sort(np.concatenate([offs[1:], cuts]))
    words = np.searchsorted(s, le) - np.searchsorted(s, ls)
    text = np.repeat(np.arange(len(offs) - 1), 1 + _per_text(buf == 10, offs))
    has = np.flatnonzero(words)
    key = tokens.mix(tokens.spans_hash(buf, ls[has], le[has]) + text[has].astype(np.uint64) * tokens.U(tokens.BASE))
    again = np.ones(len(has), bool)
    again[np.unique(key, return_index=True)[1]] = False
    out["n_dup_lines"] = np.bincount(text[has][again], minlength=len(arr))
    out["n_repeat_words"] = _per_text(repeated(h, at, WINDOW), at)
    for n in LIMITS:
        out[f"chars_rep_{n}"] = _per_text(repeated(h, at, n) * size, at)
    in_words = np.concatenate([[0], np.cumsum(size)])
    line_chars = in_words[np.searchsorted(s, le[has])] - in_words[np.searchsorted(s, ls[has])]
    out["chars_dup_lines"] = np.bincount(text[has][again], line_chars[again], len(arr)).astype(np.int64)
    return {c: out[c] for c in COLUMNS}


def _run(keep: list[str], names: list[str]):
    """Columns of keep as they come, then COLUMNS under names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch, size=1 << 19):
                found = measure(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(found[c], pa.int64()) for c in COLUMNS)], names=[*keep, *names])

    return run


def _verdict(prefix: str = "") -> tuple[Column, Column]:
    """Whether the base rule fails, and whether the text is kept."""
    col = lambda c: F.col(prefix + c)
    failed = (col("n_words") < MIN_WORDS) | (100 * col("n_repeat_words") > 50 * col("n_words"))
    bad = (100 * col("chars_dup_lines") > LINE_LIMIT * col("word_chars")) | (100 * col("n_symbols") > SYMBOL_LIMIT * col("n_words"))
    for n, most in LIMITS.items():
        bad = bad | (100 * col(f"chars_rep_{n}") > most * col("word_chars"))
    return failed, ~failed & ~bad


def assess(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): COLUMNS, base_failed and kept.

    A null text counts as empty: it has no words, fails the base rule and is not kept. A null doc_id stays null. Repeated rows
    come back as often as they came. Other columns of docs are not read. An empty table gives no rows.
    """
    bounded(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(_run(["doc_id"], list(COLUMNS)), "doc_id long, " + ", ".join(f"{c} long" for c in COLUMNS))
    failed, kept = _verdict()
    return found.withColumn("base_failed", failed).withColumn("kept", kept)


def passing(docs: DataFrame) -> DataFrame:
    """The rows of docs that assess() would keep, with all their columns; text must be a string column.

    Null and empty texts go, as assess() keeps none; repeated rows go or stay alike, a null doc_id makes no difference. Columns
    may have any names but text's twice. An empty table gives no rows.
    """
    bounded(docs.sparkSession)
    prefix = "_quality_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + "".join(f", {prefix}{c} long" for c in COLUMNS)
    found = docs.mapInArrow(_run(docs.columns, [prefix + c for c in COLUMNS]), shape)
    return found.where(_verdict(prefix)[1]).select(*docs.columns)
