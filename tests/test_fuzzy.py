"""Fuzzy searches against a scorer of its own: whole word lists, a table of subsequences, no bounds."""

import pytest
from pyspark.sql import functions as F

from agora.functions import fuzzy
from agora.operators import fuzzy_index, search
from agora.plans import records, searches  # noqa: F401  fills records.QUERIES

QUERY = "thnt the ering"


def common(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, line[j] = line[j], diagonal + 1 if x == y else max(line[j], line[j - 1])
    return line[-1]


def plain_score(a, b):
    """Each pair of the shared words and the two lists of shared words followed by the rest: twice the common letters over all."""
    x, y = sorted(set(a.split())), sorted(set(b.split()))
    if not x or not y:
        return 0.0
    shared = [w for w in x if w in y]
    one, two = (shared + [w for w in words if w not in shared] for words in (x, y))
    if shared and (one == shared or two == shared):
        return 100.0
    texts = [" ".join(t) for t in (shared, one, two)]
    pairs = [(1, 2), (0, 1), (0, 2)] if shared else [(1, 2)]
    return max(200.0 * common(texts[i], texts[j]) / (len(texts[i]) + len(texts[j])) for i, j in pairs)


@pytest.fixture(scope="module")
def short(spark, data):
    """Every document with its words up to the 60th, so that tables of subsequences stay small."""
    rows = [(r.doc_id, " ".join((r.text or "").lower().split()[:60])) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows += [(10_001, None), (10_002, ""), (10_003, "the"), (10_004, "ering the thnt"), (10_005, "thnt thnt"), (10_006, "thn ther ing"), (10_007, "é 中文"), (10_008, "ering the thnt")]
    return spark.createDataFrame(rows, "doc_id long, search_text string")


@pytest.mark.parametrize("query", [QUERY, "the", "zzz qqq", "thn ther in", "the the of", "é 中"])
def test_direct_and_indexed_equal_a_plain_scorer(spark, short, tmp_path, query):
    want = sorted((r.doc_id, round(s, 6)) for r in short.collect() if (s := plain_score(r.search_text or "", query)) >= fuzzy.CUTOFF)
    index = fuzzy_index.build(short, "doc_id", "search_text", str(tmp_path))
    again = fuzzy_index.load(spark, "doc_id", str(tmp_path))
    for found in (search.fuzzy_scores(short, query, "search_text"), fuzzy_index.search(short, index, query, "search_text"), fuzzy_index.search(short, again, query, "search_text")):
        assert sorted((r.doc_id, round(r.score, 6)) for r in found.collect()) == want


def test_blank_query_and_empty_table(spark, short, tmp_path):
    index = fuzzy_index.build(short, "doc_id", "search_text", str(tmp_path / "a"))
    assert fuzzy_index.search(short, index, " ", "search_text").where("score is null").count() == short.count()
    none = short.limit(0)
    assert fuzzy_index.search(none, fuzzy_index.build(none, "doc_id", "search_text", str(tmp_path / "b")), "the", "search_text").count() == 0


def test_queries_agree(spark, data):
    one, two = ([tuple(r) for r in records.QUERIES[n](spark, data).collect()] for n in ("sr1_fuzzy_filter", "sr1_indexed_filter"))
    assert one == two and one


def test_no_table_where_the_bound_is_under_the_cutoff(monkeypatch):
    def looked(a, b):
        raise AssertionError("a text was looked at")

    monkeypatch.setattr(fuzzy, "_lcs", looked)
    long = " ".join(f"w{i}" for i in range(500))
    assert fuzzy.token_set_ratio(long, QUERY, fuzzy.CUTOFF) < fuzzy.CUTOFF
    assert fuzzy.token_set_ratio(long + " the", "the", fuzzy.CUTOFF) == 100.0
    with pytest.raises(AssertionError):
        fuzzy.token_set_ratio("thn thr", QUERY, fuzzy.CUTOFF)


def test_index_reads_only_its_words(spark, short, tmp_path):
    index = fuzzy_index.build(short, "doc_id", "search_text", str(tmp_path))
    plan = fuzzy_index.candidates(index, QUERY)._jdf.queryExecution().toString()
    assert "In(token, [ering,the,thnt])" in plan and "PushedFilters" in plan
    few = fuzzy_index.candidates(index, "zzz qqq").count()
    assert few < short.count() / 2
    assert fuzzy_index.candidates(index, "the").where(F.col("least") == 100).count() > 0


def whole(text):
    return " ".join((text or "").lower().split())


def test_release_search_rows(spark, data):
    """sr2's rows and scores: English documents of any third party, the first 800 letters of their bodies among the searched."""
    docs = spark.read.parquet(f"{data}/documents.parquet").where("lang = 'en'").collect()
    scored = {r.doc_id: plain_score(whole(f"{r.source} {r.doc_id} {(r.text or '')[:800]}"), QUERY) for r in docs}
    want = [(i, round(s, 6)) for i, s in sorted(scored.items(), reverse=True) if s >= fuzzy.CUTOFF]
    assert [tuple(r) for r in records.QUERIES["sr2_release_search"](spark, data).collect()] == want and want


def test_bill_search_rows(spark, data, duck):
    from agora.plans import shaped  # noqa: F401

    texts = duck.execute(records.SQL["p12_bill_search_text"]).fetchall()
    score = {t: plain_score(t, "a f r") for _, t in texts}
    want = sorted((-round(score[t], 6), i) for i, t in texts if score[t] >= fuzzy.CUTOFF)
    assert [(-r.score, r.l_orderkey) for r in records.QUERIES["sr3_bill_search"](spark, data).collect()] == want and want


def test_text_neighbours_rows(spark, data):
    import numpy as np

    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    asked = min((r.item_id, r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect())[1]
    v = search.HashingEmbedder(64)([t for _, t in docs] + [asked]).astype(np.float32).astype(float)
    n = np.linalg.norm(v, axis=1)
    best = sorted((-round(float(v[k] @ v[-1] / (n[k] * n[-1])), 6), i) for k, (i, _) in enumerate(docs) if n[k])[:10]
    got = [(r.doc_id, r.score) for r in records.QUERIES["sr8_text_neighbours"](spark, data).collect()]
    assert [i for i, _ in got] == [i for _, i in best] and [s for _, s in got] == pytest.approx([-s for s, _ in best], abs=2e-6)


def test_unescaped_pages(spark, data):
    import hashlib
    import html
    import re

    from agora.plans import texts  # noqa: F401

    pages = {r.page_id: r.html or "" for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    want = {i: hashlib.sha1(html.unescape(re.sub("<[^>]+>", " ", t)).encode()).hexdigest() for i, t in pages.items()}
    assert {r.page_id: r.plain_sha1 for r in records.QUERIES["f10_unescape"](spark, data).collect()} == want


def test_texts_are_scored_once_and_indexed_without_a_shuffle(spark, short, tmp_path):
    rows = short.withColumn("position", F.col("doc_id"))
    assert "ArrowEvalPython" not in search.fuzzy_filter(rows, QUERY, "search_text", "position")._jdf.queryExecution().toString()
    assert len(fuzzy_index.build(short.repartition(3), "doc_id", "search_text", str(tmp_path)).postings.inputFiles()) == 3
