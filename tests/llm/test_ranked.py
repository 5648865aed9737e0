import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from agora.llm import ranked
from agora.llm.queries import ORACLES, QUERIES

DOCS, ITEMS = "doc_id long, text string, term string, n long", "item_id long, text string, rank int"


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, k=10):
    bags = [(r[0], Counter(words(r[1]))) for r in docs]
    n, length = sum(1 for _, b in bags if b), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text, *_ in items:
        got = []
        for i, b in bags:
            m = 25 + (75 * b.total() * n) // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in words(text) if b[t])
            if s > 0:
                got.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(got)[:k], 1)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_sql(same):
    same(QUERIES["op11_ranked_search"], ORACLES["op11_ranked_search"])


def tables(spark, docs, items):
    return spark.createDataFrame([(*r, "x", 1) for r in docs], DOCS), spark.createDataFrame([(*r, 5) for r in items], ITEMS)


@pytest.mark.parametrize("docs_in_a_shard", [1 << 16, 7])
def test_shards_and_blocks_equal_brute_force(spark, monkeypatch, docs_in_a_shard):
    for name, value in (("DOCS", docs_in_a_shard), ("POSTINGS", 60), ("STEP", 2), ("ITEMS", 7)):
        monkeypatch.setattr(ranked, name, value)
    rng = np.random.default_rng(2)
    text = lambda n: " ".join(f"w{int(x)}" for x in rng.zipf(1.3, n) % 80)
    docs = [(int(i), text(int(rng.integers(1, 40)))) for i in rng.permutation(150)] + [(i, "w1 w2 w3 w1") for i in range(400, 460)]
    items = [(i, text(6)) for i in range(20)]
    d, q = tables(spark, docs, items)
    assert found(ranked.rank(d.repartition(3), q)) == brute(docs, items)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, " .,\x00\t"), (4, "Émile ÉMILE emile A-b_c 中文,中文"), (5, "a b c"), (5, "a b c"), (5, "c d"), (None, "a b c"), (None, None), (6, "long " * 300_000 + "a"), (7, "x" * 3_000_000 + " a")]
    items = [(1, "A a b"), (1, "zzz"), (2, None), (None, "émile 中文"), (3, ""), (4, "A a b"), (4, "A a b"), (5, "long " * 9)]
    d, q = tables(spark, docs, items)
    assert found(ranked.rank(d, q)) == brute(docs, items)
    for a, b in ((d.limit(0), q), (d, q.limit(0)), (d.where("doc_id < 4"), q)):
        assert ranked.rank(a, b).collect() == []


def test_reading_stops_early(monkeypatch):
    """One document holds far more of the terms than all others: few of these are looked up."""
    n = 20_000
    tf = np.concatenate([[50, 50], np.ones(2 * n - 2, np.int64)])
    s = ranked.Shard(pa.array(range(n)), np.full(n, 100), np.full(n, 2), np.tile([0, 1], n), tf, 2, n, 100 * n)
    looked, scores = [], s.scores
    monkeypatch.setattr(s, "scores", lambda docs, *a: looked.append(len(docs)) or scores(docs, *a))
    best, _ = s.search(np.array([0, 1]), np.array([3, 4]), 1)
    assert best.tolist() == [0] and sum(looked) <= 2 * ranked.STEP
