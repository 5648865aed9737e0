"""Folds that stop and go on, answers of models, crawls with recorded pages, vector collections, choices of clusters."""

import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.operators import clusters, fold, runs, select, vectors
from agora.plans import records, searches, shaped, texts  # noqa: F401
from agora.sources import crawl, files, sinks


class Status(Exception):
    def __init__(self, status):
        super().__init__(status)
        self.status = status


def test_states_are_kept_and_taken_up(spark):
    docs = spark.createDataFrame([(m, p, "a b" if p % 2 else "b") for m in ("x", "y") for p in range(7)], "member string, position int, body string")
    whole = {r.member: dict(r.profile) for r in runs.last_states(runs.fold_states(docs, ["a", "b"], 3)).collect()}
    assert whole == {"x": {"a": 3, "b": 7}, "y": {"a": 3, "b": 7}}
    states = runs.fold_states(docs, ["a", "b"], 3, stop_after=5)
    assert sorted((r.member, r.next_index, r.final) for r in states.collect()) == [(m, k, False) for m in ("x", "y") for k in (3, 5)]
    on = runs.fold_states(docs, ["a", "b"], 100, states=runs.last_states(states))
    assert {r.member: dict(r.profile) for r in on.collect()} == whole
    assert runs.resumes(3, 3, 3) and not runs.resumes(3, 2, 1) and not runs.resumes(3, 3, 4) and not runs.resumes(3, None, None)
    longer = docs.union(spark.createDataFrame([("x", 9, "a")], docs.schema))  # the source grew: its fold starts over
    assert {r.member: dict(r.profile) for r in runs.fold_states(longer, ["a", "b"], 100, states=runs.last_states(states)).collect()}["x"] == {"a": 4, "b": 7}


def test_completion_falls_back_and_tries_again():
    asked = []

    def ask(stream):
        asked.append(stream)
        if stream:
            raise Status(404)
        if len(asked) < 3:
            raise Status(503)
        return "text"

    assert runs.complete(ask, sleep=lambda s: None) == "text" and asked == [True, False, False]
    for error in (Status(401), ValueError()):
        with pytest.raises(type(error)):
            runs.complete(lambda s, e=error: (_ for _ in ()).throw(e), sleep=lambda s: None)
    tries = []
    with pytest.raises(TimeoutError):
        runs.complete(lambda s: tries.append(s) or (_ for _ in ()).throw(TimeoutError()), sleep=lambda s: None)
    assert len(tries) == 3


def test_streamed_answers():
    assert fold.event_text(['{"delta": " a"}', "data: [DONE]", ":x", "data: {no", 'data: {"choices": [{"delta": {"content": [{"text": "b"}, "c"]}}]}', "[1]"]) == "abc"
    assert fold.event_text(['{"text": "x"}', '{"response": {"choices": [{"message": {"content": "whole "}}]}}']) == "whole"
    for bad in (['{"type": "response.error", "error": {"message": "no"}}'], ['{"type": "error", "error": "no"}'], ['{"delta": " "}'], []):
        with pytest.raises(RuntimeError):
            fold.event_text(bad)
    assert fold.event_text(['{"error": "a field", "delta": "goes on"}']) == "goes on"


def test_memo_and_signatures(spark, tmp_path):
    a, b = runs.signature("f", 1, query=" The  BILL ", party="D"), runs.signature("f", 1, query="the bill", party="D")
    assert a == b != runs.signature("f", 2, query="the bill", party="D") and a != runs.signature("f", 1, query="the bill", party="R")
    memo, made = runs.Memo(2), []
    make = lambda: made.append(1) or spark.range(3)
    assert all(memo.get(k, make).count() == 3 for k in ("a", "a", "b", "c", "a")) and len(made) == 4
    assert [memo.page("s", 3), memo.page("s", 3), memo.page("t", 3)] == [1, 3, 1]
    (tmp_path / "x.json").write_text('{"v": 1}')
    memo.preload(spark, {"1": str(tmp_path / "x.json"), "2": str(tmp_path / "." / "x.json"), "3": str(tmp_path / "none.json")}, "v int")
    assert list(memo.failed) == [str(tmp_path / "none.json")]


PAGES = {
    "https://a.gov/l": '<a href="/media/press-releases/two">2</a><a rel="next" href="/l2">n</a>',
    "https://a.gov/l2": '<a href="/media/press-releases/one/">1</a><a href="/media/press-releases/two">2</a><a rel="next" href="/l">n</a>',
    "https://a.gov/media/press-releases/one/": "<h1>One &amp;\n 1</h1>",
    "https://a.gov/media/press-releases/two": '<h1>Two</h1><div class="col-auto"></div><div class="col-auto">May 1, 2026</div><div class="evo-press-release__body"><p>x</p><div>y</div>',
    "https://b.gov/l": "<p>nothing</p>",
}


def test_crawls(spark):
    assert [r[0].rsplit("/m", 1)[-1] for r in crawl.crawl("https://a.gov/l", PAGES.__getitem__)] == ["edia/press-releases/one/", "edia/press-releases/two"]
    assert [r[0] for r in crawl.crawl("https://a.gov/l", PAGES.__getitem__, 1)] == ["https://a.gov/media/press-releases/two"]
    members = spark.createDataFrame([("A", "https://a.gov/l"), ("B", "https://b.gov/l"), ("C", "https://c.gov/l"), ("D", None)], "bioguideId string, start string")
    rows = crawl.crawl_members(members, PAGES.__getitem__).collect()
    assert sorted((r.bioguideId, r.status) for r in rows) == [("A", "ok"), ("A", "ok"), ("B", "no_releases"), ("C", "error"), ("D", "skipped")]
    two = next(r for r in rows if r.title == "Two")
    assert (two.date, two.bodyHtml, two.bodyText) == ("May 1, 2026", "<p>x</p><div>y</div>", "x y")


def test_release_pages_by_their_rules():
    body = '<div class="x evo-press-release__body"><p>A &lt;b&gt; B</p>\n <br/><!-- c --><div>in</div>tail</div><div>out</div>'
    assert files.page_parts(f'<h1> A\n b </h1><div class="col-auto">Share</div><div class="col-auto">May 1, 2026</div>{body}') == ("A b", None, None, "<p>A &lt;b&gt; B</p><br/><div>in</div>tail", "A B in tail")
    assert files.page_parts(None) == (None,) * 5 and files.page_parts("<h1></h1>")[0] is None


def test_bill_details(spark):
    def get(url):
        kind, number = url.split("/")[-2:] if url.split("/")[-1].isdigit() else url.split("/")[-3:-1]
        if number == "2":
            raise OSError("down")
        if url.endswith("/summaries"):
            return {"summaries": [{"text": "s"}]}
        if url.endswith("/subjects"):
            raise OSError("down")
        return {"bill": {"title": kind}}

    bills = spark.createDataFrame([(119, "HR", "1"), (119, "S", "2")], "congress int, type string, number string")
    got = {r.number: (r.bill, r.summaries, r.subjects) for r in crawl.bill_details(bills, get, "http://x").collect()}
    assert got == {"1": ('{"title": "hr"}', '[{"text": "s"}]', "[]"), "2": (None, "[]", "[]")}


def test_archives_in_order(spark, tmp_path):
    for name, held in (("a.zip", {"x/M1.json": "1"}), ("b.zip", {"M1.json": "2", "M2.json": "3", "note.txt": "-"})):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k, v in held.items():
                z.writestr(k, v)
    wanted = spark.createDataFrame([("M1",), ("M2",), ("M3",)], "member string")
    got = {r.member: (r.archive, r.value) for r in crawl.first_archive(spark, [str(tmp_path / "a.zip"), str(tmp_path / "b.zip")], wanted).collect()}
    assert got == {"M1": (0, "1"), "M2": (1, "3"), "M3": (-1, None)}


def test_upserts_of_a_table(spark):
    files.ensure_collection(spark, "upserted_vectors", 2)
    rows = lambda ids, model: sinks.vector_rows(spark.createDataFrame([(i, [1.0, float(i)]) for i in ids], "i int, e array<double>"), ["i"], "e", model, F.struct("i"))
    for ids, model in (((1, 2), "a"), ((2, 3), "b"), ((2, 3), "b")):
        sinks.upsert(spark, "upserted_vectors", rows(ids, model))
    assert sorted((r.key, r.model) for r in spark.table("upserted_vectors").collect()) == [("1", "a"), ("2", "b"), ("3", "b")]
    assert [tuple(r) for r in sinks.collection_stats({"c": spark.table("upserted_vectors")}).collect()] == [("c", 3, 2)]


def blobs(spark, n=60, k=3, apart=6.0):
    rng = np.random.default_rng(3)
    centre = np.eye(k, 4) * apart
    return spark.createDataFrame([(i, [float(x) for x in centre[i % k] + rng.normal(0, 0.3, 4)]) for i in range(n)], "vec_id long, embedding array<double>")


def test_the_best_number_of_clusters(spark):
    assert clusters.best_of([{"k": 2, "mpc": math.nan}, {"k": 3, "mpc": 0.5}, {"k": 4, "mpc": 0.5}], "mpc") == 3 and clusters.best_of([], "fpc") is None
    assert clusters.best_of([{"k": 2, "xie_beni": 0.5}, {"k": 3, "xie_beni": 0.2}], "xie_beni") == 3
    points = blobs(spark)
    rows, fit = clusters.fuzzy_labels(points, m=1.5)
    assert fit["k"] == 3 and not fit["collapsed"] and len({(r.vec_id % 3, r.cluster) for r in rows.collect()}) == 3
    flat, same = clusters.fuzzy_labels(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(6)], points.schema), 2)
    assert same["collapsed"] and flat.count() == 6
    named, means = clusters.kmeans_labels(points)
    assert means["k"] == 3 and len({(r.vec_id % 3, r.cluster) for r in named.collect()}) == 3
    assert clusters.fuzzy_labels(points.limit(3))[1] == {"k": 1, "collapsed": False}


def test_limits_of_distance_and_graphs(spark):
    points = blobs(spark, 30)
    near = vectors.neighbours(points, 3)
    assert clusters.distance_limit(near) is clusters.distance_limit(near, "none") is None and clusters.distance_limit(near, 0.25) == 0.25
    limit = clusters.distance_limit(near, "percentile", 50.0)
    assert limit == pytest.approx(np.quantile([r.distance for r in near.collect()], 0.5))
    assert len({(r.id % 3, r.cluster) for r in clusters.graph_labels(points, 5).collect()}) == 3
    with pytest.raises(ValueError):
        clusters.guard(points.unionByName(spark.createDataFrame([(99, [1.0])], points.schema)))


def test_selections(spark):
    files_ = spark.createDataFrame([("m", "a", 1, 5, "x"), ("m", "b", 2, 1, "y"), ("m", "c", 2, 3, None)], "m string, path string, embeddingCount int, mtimeNs long, sourceFolder string")
    assert select.biggest_file(files_, "m").first()["path"] == "c" and select.biggest_file(files_, "m", "x").first()["path"] == "a"
    assert tuple(select.run_counters(spark.createDataFrame([(1,), (1,), (2,), (None,)], "k int"), spark.createDataFrame([(2,), (3,)], "k int"), "k").first()) == (2, 2, 1, 1)
    assert select.matching_members(spark.createDataFrame([("A1", "Lee, Ann", "D", "CA")], "bioguideId string, name string, partyName string, state string"), "  ").count() == 1


# Queries that SQL cannot express, against plain Python and numpy over the same tables.


@pytest.fixture(scope="module")
def points(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)


def test_principal_components(spark, data, points):
    ids, x = points
    c = x - x.mean(0)
    u, s, v = np.linalg.svd(c, full_matrices=False)
    want = c @ (v[:2].T * np.sign(v[:2][np.arange(2), np.abs(v[:2]).argmax(1)]))
    got = {r.vec_id: (r.x, r.y) for r in records.QUERIES["v1_pca_project"](spark, data).collect()}
    assert np.allclose([got[i] for i in ids], want, atol=1e-3)


def test_fuzzy_fit_is_a_fixed_point(spark, data, points):
    _, x = points
    centres, scores = vectors.fuzzy_c_means(spark.read.parquet(f"{data}/embeddings.parquet"), 4, m=1.3)
    u = vectors.memberships(x, centres, 1.3)
    w = u**1.3
    assert np.allclose((w.T @ x) / w.sum(0)[:, None], centres, atol=1e-3)
    assert scores["fpc"] == pytest.approx((u**2).sum() / len(x), abs=1e-4)
    assert scores["objective"] == pytest.approx((w * ((x[:, None] - centres[None]) ** 2).sum(2)).sum(), rel=1e-3)


def test_graph_components(spark, data, points):
    ids, x = points
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.round(1 - unit @ unit.T, 6)
    np.fill_diagonal(d, np.inf)
    near = [set(sorted(range(len(ids)), key=lambda j: (d[i, j], ids[j]))[: searches.K]) for i in range(len(ids))]
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, js in enumerate(near):
        for j in js:
            if i in near[j]:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    size = np.bincount([root(i) for i in range(len(ids))], minlength=len(ids))
    order = {r: k for k, r in enumerate(sorted((r for r in range(len(ids)) if size[r] >= 3), key=lambda r: (-size[r], ids[r])))}
    assert {r.id: r.cluster for r in records.QUERIES["v10_knn_components"](spark, data).collect()} == {i: order.get(root(k), -1) for k, i in enumerate(ids)}


@pytest.mark.parametrize(("name", "rows"), [("sr1_fuzzy_filter", None), ("sr4_stance_preview", 60)])
def test_fuzzy_searches(spark, data, name, rows):
    from agora.functions.fuzzy import CUTOFF, token_set_ratio

    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    scored = sorted(((-round(token_set_ratio(" ".join((r.text or "").lower().split()), "thnt the ering"), 6), r.doc_id) for r in docs))
    want = [(i, -s) for s, i in scored if -s >= CUTOFF][:rows]
    assert [tuple(r) for r in records.QUERIES[name](spark, data).collect()] == pytest.approx(want) if not want else [r[0] for r in records.QUERIES[name](spark, data).collect()] == [i for i, _ in want]


def test_release_search_is_by_time(spark, data):
    ids = [r.doc_id for r in records.QUERIES["sr2_release_search"](spark, data).collect()]
    assert ids == sorted(ids, reverse=True)
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    assert all(langs[i] == "en" for i in ids)


def test_samples_do_not_depend_on_partitions(spark, data):
    from agora.operators.order import sample

    d = spark.read.parquet(f"{data}/documents.parquet").select("doc_id")
    a, b = (sorted(r.doc_id for r in sample(d.repartition(n), "doc_id", 17, 4).collect()) for n in (1, 7))
    assert a == b and len(a) == 17 and a != sorted(r.doc_id for r in sample(d, "doc_id", 17, 5).collect())


def test_unescaped_text(spark, data):
    import html

    q = records.QUERIES["f10_unescape"](spark, data)
    text = next(c for c in q.columns if c != "page_id")
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    for r in q.collect():
        assert r[text] is not None and html.unescape(r[text]) is not None and r.page_id in pages


def test_scans_of_k(spark, data):
    v8 = records.QUERIES["v8_kmeans_scan"](spark, data).collect()
    n = spark.read.parquet(f"{data}/embeddings.parquet").count()
    assert [r.k for r in v8] == [float(k) for k in range(2, min(30, max(3, int(n**0.5) + 8)) + 1)] and all(-1 <= r.silhouette <= 1 for r in v8)
    v6 = records.QUERIES["v6_fcm_scan"](spark, data).collect()
    assert [r.k for r in v6] == [float(k) for k in range(2, min(12, max(3, int(n**0.5))) + 1)]
    assert all(r.mpc == pytest.approx((r.fpc - 1 / r.k) / (1 - 1 / r.k)) for r in v6)
    assert json.dumps([r.k for r in v6])
