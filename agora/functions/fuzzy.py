"""What built-in functions cannot express: token-set similarity, entities of HTML, mis-decoded text."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scores from here on count as a match.
CUTOFF = 42


def _lcs(a: str, b: str) -> int:
    """Length of a longest common subsequence, by one whole number with a bit for each character of the shorter text."""
    a, b = sorted((a, b), key=len)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def set_bounds(shared: float, left: float, right: float) -> tuple[float, float]:
    """What two word sets score at least and at most, from the lengths of the shared words and of either rest, each joined by
    spaces; 0 means none. The shared words against either list is exact; the two lists can at best agree in the shorter rest."""
    if shared and not (left and right):
        return 100.0, 100.0
    least = 200.0 * shared / (2 * shared + 1 + min(left, right)) if shared else 0.0
    ahead = shared + 1 if shared else 0
    return least, max(least, 200.0 * (ahead + min(left, right)) / (2 * ahead + left + right))


def token_set_ratio(a: str, b: str, cutoff: float = 0.0) -> float:
    """Words as sets: 100 if one set holds the other, else the best similarity among the shared and the full word lists.

    Exact from cutoff on. Where no score of cutoff can be reached it is the part that lengths tell, without a look at the texts."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(x & y)
    shared = len(both)
    rest = [max(0, len(" ".join(w)) - shared - bool(shared)) for w in (x, y)]
    least, most = set_bounds(shared, *rest)
    if most < cutoff or most <= least:
        return least
    ahead = shared + 1 if shared else 0
    return max(least, 200.0 * (ahead + _lcs(" ".join(sorted(x - y)), " ".join(sorted(y - x)))) / (2 * ahead + sum(rest)))


def token_set_score(text: Column, query: Column, cutoff: float = 0.0) -> Column:
    """token_set_ratio of two columns; null counts as empty."""

    @F.pandas_udf(T.DoubleType())
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([token_set_ratio(x or "", y or "", cutoff) for x, y in zip(a, b, strict=True)], dtype=float)

    return score(text, query)


@F.pandas_udf(T.StringType())
def unescape_html(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


def repair_text(t: str | None) -> str | None:
    """UTF-8 that was read as cp1252, encoded back and read again; kept only if fewer marks of the error are left."""
    if not t or "â" not in t:
        return t
    again = t.encode("cp1252", "ignore").decode("utf-8", "ignore")
    return again if again.count("â") < t.count("â") else t


@F.pandas_udf(T.StringType())
def repair_mojibake(text: pd.Series) -> pd.Series:
    return text.map(repair_text)


def subset_match(text: Column, query: str) -> Column:
    """Whether all words of the query are among those of the text, or the reverse: the case of score 100, without Python."""
    words = F.array_distinct(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""))
    asked = F.array(*(F.lit(w) for w in sorted(set(query.split())))) if query.split() else F.array().cast("array<string>")
    return (F.size(words) > 0) & (F.size(asked) > 0) & ((F.size(F.array_except(asked, words)) == 0) | (F.size(F.array_except(words, asked)) == 0))
