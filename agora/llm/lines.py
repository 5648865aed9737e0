"""Line dedup: windows of three consecutive lines, found again anywhere in the corpus, are removed but for the first.

Only DataFrame functions: lines are hashed, windows are exploded as hashes, and the text itself is moved at most once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.llm.shared import cut, drop, fresh, look_up, small

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def covered(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, spans): for each document with a repeated window its lines to remove, as merged spans (s, e) of line numbers from
    0, e exclusive. Lines count as they stand, blank lines too; a document of fewer lines than window holds none. Of the places
    of a window, ordered by doc_id and line, the first stays."""
    line = F.transform(_lines(F.col("text")), lambda x: F.xxhash64(x))
    other = F.transform(_lines(F.col("text")), lambda x: F.hash(x))
    # Both hashes of a window together: 96 bits, so that different windows do not meet among 10 ** 12.
    hashed = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), line.alias("x"), other.alias("y")).where(F.size("x") >= window)
    at = F.transform(F.sequence(F.lit(0), F.size("x") - window), lambda i: F.struct(F.xxhash64(*(F.get("x", i + k) for k in range(window))).alias("a"), F.hash(*(F.get("y", i + k) for k in range(window))).alias("b")))
    places = cut(hashed.select("doc_id", F.posexplode(at).alias("line", "w")).select("doc_id", "line", "w.a", "w.b"), "windows")
    # A place as one number, by which hash aggregates can take the first; repeated rows of a document count once.
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(1 << 31).cast("decimal(11,0)") + F.col("line")
    firsts = places.groupBy("a", "b").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("c")).where("first <> last").select("a", "b", "first", "c")
    firsts = cut(firsts, "firsts")
    later = look_up(places, firsts, ["a", "b"], "c").where(place != F.col("first")).select("doc_id", "line")
    out = cut(later.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines")).select("doc_id", _merged(F.col("lines"), window).alias("spans")), "covered")
    drop(places)
    drop(firsts)
    return out


def _merged(lines: Column, window: int) -> Column:
    """Sorted window starts as spans: a span begins where the start before is over window lines back, and ends likewise."""
    n = F.size(lines)
    index = F.sequence(F.lit(0), n - 1)
    begins = F.filter(index, lambda i: (i == 0) | (F.get(lines, i) - F.get(lines, F.greatest(i - 1, F.lit(0))) > window))
    ends = F.filter(index, lambda i: (i == n - 1) | (F.get(lines, F.least(i + 1, n - 1)) - F.get(lines, i) > window))
    return F.zip_with(begins, ends, lambda a, b: F.struct(F.get(lines, a).alias("s"), (F.get(lines, b) + window).alias("e")))


def remaining(text: Column, spans: Column) -> Column:
    """text without the lines of spans: the slices between them, joined by line ends again."""
    lines = _lines(text)
    last = F.size(lines)
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["e"]))
    stops = F.concat(F.transform(spans, lambda s: s["s"]), F.array(last))
    kept = F.flatten(F.zip_with(starts, stops, lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0)))))
    return F.array_join(kept, "\n")


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with texts rid of repeated windows, all columns kept, and n_lines, n_removed (long) added.

    Texts without a repeated window stay as they are, null too (it counts as one empty line). Rows with a null doc_id are left
    alone. Repeated rows of one doc_id count as one document: its windows repeat themselves only at other lines. Columns of docs
    named n_lines or n_removed are replaced. An empty table gives no rows.
    """
    spans = covered(docs, window)
    n = spans.agg(F.sum(F.size("spans") + 4)).first()[0] or 0  # by 8 bytes a span, and what a row has besides
    keep = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    ident, held = fresh(docs, "_lines_id"), fresh(docs, "_lines_spans")
    side = spans.select(F.col("doc_id").alias(ident), F.col("spans").alias(held))
    joined = docs.join(small(side, -(-n // 8)), F.col("doc_id") == F.col(ident), "left")
    new = F.when(F.col(held).isNull(), F.col("text")).otherwise(remaining(F.col("text"), F.col(held)))
    gone = F.aggregate(held, F.lit(0), lambda t, s: t + s["e"] - s["s"])
    return joined.select(*(new.alias(c) if c == "text" else docs[c] for c in keep), F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), F.coalesce(gone, F.lit(0)).cast("long").alias("n_removed"))
