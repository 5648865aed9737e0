import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.operators import counts, fold, merge, neighbours, order, search, vectors


def test_merge_bills_first_and_last_wins(spark):
    rows = [("b", 1, "2024-01-02", "old", "s1", ["Unknown", "D"], ["x"], ["v1", "v2"]), ("b", 2, "2024-01-02", "", "s2", ["R"], ["x"], ["v2"]), ("b", 3, None, "new", "s3", [], ["y"], ["v3"]), ("c", 1, "2024", "t", "s", [], [], [])]
    df = spark.createDataFrame(rows, "bill_key string, position int, update_date string, title string, summary string, parties array<string>, states array<string>, votes array<string>")
    got = [r.asDict() for r in merge.merge_bills(df).collect()]
    assert got == [{"bill_key": "b", "title": "new", "summary": "s1", "latest_update": "2024-01-02", "parties": ["D", "R"], "states": ["x", "y"], "raw_votes": 4, "version_count": 3, "vote_count": 3}]
    assert merge.totals(df).first().asDict() == {"input_rows": 4, "voted_rows": 3, "raw_votes": 4, "bills": 1, "votes": 3}


def test_vote_counts_spellings(spark):
    df = spark.createDataFrame([("m", v) for v in ("Aye", " yea ", "Not Voting.", "NV", None, "No", "Present")], "m string, v string")
    assert counts.vote_counts(df, ["m"], "v").first().asDict() == {"m": "m", "yea": 2, "nay": 1, "present": 1, "notVoting": 1, "other": 2}
    assert counts.vote_counts(df.limit(0), ["m"], "v").count() == 0


def test_classify(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, h string"), spark.createDataFrame([(1, "x"), (2, "q"), (4, "z")], "k int, h string")
    assert {(r.k, r.action) for r in merge.classify(a, b, ["k"], "h").collect()} == {(1, "reuse"), (2, "embed"), (3, "embed"), (4, "delete")}


def test_subjects(spark):
    mapping = [("Health", "health_care"), ("Immigration", "immigration"), ("Taxation", "tax_reform"), ("Administrative law", "government_reform")]
    df = spark.createDataFrame([("Administrative law and regulatory procedures",), ("Health care costs and insurance",), ("Immigration",), ("Taxation",), ("Sports",), (None,)], "subject string")
    assert [r.issue for r in merge.subjects_to_issues(df, mapping).collect()] == ["government_reform", "health_care", "immigration", "tax_reform"]


def test_pages_partition_the_result(spark):
    df = spark.range(10)
    pages = [[r.id for r in order.page(df, [F.col("id")], n, 4).collect()] for n in (1, 2, 3, 9, -1)]
    assert pages == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9], [8, 9], [0, 1, 2, 3]]
    assert order.page(df.limit(0), [F.col("id")], 3, 4).count() == 0
    assert order.sample(df, "id", 4).count() == 4 and order.sample(df, "id", 40).count() == 10


def test_top_k_and_threshold(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in vectors.top_k(df, [1.0, 0.0], 10, "vec_id", "embedding").collect()] == [1, 5, 2]
    assert [r.vec_id for r in vectors.top_k(df, [1.0, 0.0], 10, "vec_id", "embedding", None).collect()] == [1, 5, 2, 3]
    with pytest.raises(ValueError):
        vectors.check_dimension(df.union(spark.createDataFrame([(9, [1.0])], df.schema)), "embedding")


def test_neighbours_in_one_block_and_in_many(spark, monkeypatch):
    rng = np.random.default_rng(0)
    m = rng.standard_normal((60, 5))
    m[7] = m[3]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(m)], "vec_id long, embedding array<float>")
    one = sorted(map(tuple, vectors.neighbours(df, 4).collect()))
    monkeypatch.setattr(neighbours, "CELL", 25)
    monkeypatch.setattr(neighbours, "BLOCK", 25)
    assert sorted(map(tuple, vectors.neighbours(df, 4).collect())) == one
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    d = np.round(1 - u @ u.T, 6)
    np.fill_diagonal(d, 9)
    want = sorted((i, int(j), r + 1, float(d[i, j])) for i in range(60) for r, j in enumerate(np.lexsort((np.arange(60), d[i]))[:4]))
    assert [(a, b, c) for a, b, c, _ in one] == [(a, b, c) for a, b, c, _ in want]


def test_components_are_the_transitive_closure(spark):
    rng = np.random.default_rng(1)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2)) if a != b] + [(i, i + 1) for i in range(100, 130)]
    parent = {i: i for i in range(140)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in e:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.id: r.component for r in vectors.components(spark.range(140), spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {i: root(i) for i in range(140)}
    labels = {r.id: r.cluster for r in vectors.cluster_labels(spark.createDataFrame(list(got.items()), "id long, component long"), 3).collect()}
    assert labels[139] == -1 and min(labels.values()) == -1


def test_fuzzy_c_means_finds_two_clouds(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 0.1, (40, 3)), rng.normal(3, 0.1, (40, 3))])
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    centres, scores = vectors.fuzzy_c_means(df, 2)
    assert sorted(round(float(c.mean())) for c in centres) == [0, 3] and scores["fpc"] > 0.9
    u = vectors.membership_rows(df, centres.tolist()).select(F.aggregate("memberships", F.lit(0.0), lambda t, v: t + v).alias("s")).collect()
    assert all(math.isclose(r.s, 1.0) for r in u)
    assert vectors.xie_beni(df, [[0.0, 0.0, 0.0]]) == float("inf")
    with pytest.raises(ValueError):
        vectors.fuzzy_c_means(df, 2, m=1.0)
    best = min(vectors.fcm_scan(df, 3), key=lambda r: r["xie_beni"])
    assert best["k"] == 2


def test_projection(spark):
    x = np.array([[t, 2 * t, 0.0] for t in range(10)], float)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = np.array([(r.x, r.y) for r in vectors.project(df).orderBy("vec_id").collect()])
    assert np.allclose(got[:, 0], (x - x.mean(0)) @ np.array([1, 2, 0]) / math.sqrt(5)) and np.allclose(got[:, 1], 0, atol=1e-6)
    assert [(r.x, r.y) for r in vectors.project(df.limit(1)).collect()] == [(0.0, 0.0)] and vectors.project(df.limit(0)).count() == 0


def test_top_memberships(spark):
    assert spark.sql("select array(0.1d, 0.45d, 0.45d) u").select(vectors.top_memberships(F.col("u"), 2)).first()[0] == "C1:0.450, C2:0.450"


def docs(spark):
    return spark.createDataFrame([("m", 1, "tax jobs"), ("m", 2, " "), ("m", 3, "tax"), ("n", 1, None)], "member string, position int, body string")


def test_fold_counts_and_resumes(spark):
    got = {(r.member, r.topic): (r.evidence, r.next_index) for r in fold.fold(docs(spark), ["tax", "jobs"]).collect()}
    assert got == {("m", "tax"): (2, 3), ("m", "jobs"): (1, 3), ("n", "tax"): (0, 1), ("n", "jobs"): (0, 1)}
    states = spark.createDataFrame([("m", {"tax": 10, "jobs": 10}, 2, 3), ("n", {"tax": 5}, 0, 9)], "member string, profile map<string,int>, next_index long, total long")
    got = {(r.member, r.topic): r.evidence for r in fold.fold(docs(spark), ["tax", "jobs"], states=states).collect()}
    assert got == {("m", "tax"): 11, ("m", "jobs"): 10, ("n", "tax"): 0, ("n", "jobs"): 0}


def test_fold_rejects_lost_evidence(spark):
    def losing(profile, body):
        return {t: n - 1 for t, n in profile.items()}

    assert {(r.evidence, r.failed) for r in fold.fold(docs(spark).where("member = 'm'"), ["tax"], step=losing).collect()} == {(0, 2)}
    assert fold.regressions({"a": 2, "b": 1}, {"a": 1}) == ["a", "b"]


def test_event_text():
    assert fold.event_text([": hi", "", 'data: {"delta": "a"}', "data: junk", 'data: {"choices": [{"delta": {"content": "b"}}]}', "data: [DONE]"]) == "ab"
    assert fold.event_text(['data: {"delta": "a"}', 'data: {"response": {"output": [{"content": [{"text": "whole"}]}]}}']) == "whole"
    for lines in ([], ['data: {"error": "x"}']):
        with pytest.raises(RuntimeError):
            fold.event_text(lines)
    assert fold.backoff(3, 1.0, 5.0) == 5.0


def test_search_order(spark):
    df = spark.createDataFrame([(0, "health care", "D", 3), (1, "care act", "Independent", None), (2, "xyz", "Republican", 5)], "position int, search_text string, party string, time int")
    assert [r.position for r in search.fuzzy_filter(df, "", "search_text", "position").collect()] == [0, 1, 2]
    assert [r.position for r in search.fuzzy_filter(df, "care", "search_text", "position").collect()] == [0, 1]
    assert [r.position for r in search.search_releases(df, "care").collect()] == [0, 1]
    assert [r.position for r in search.search_releases(df, "care", newest_first=False).collect()] == [1, 0]
    assert [r.position for r in search.search_releases(df, party="Third party").collect()] == [0, 1]
    assert [r.position for r in search.search_stances(df, "xyz", F.col("position")).collect()] == [2, 0, 1]


def test_semantic_refuses_other_models(spark):
    e = search.HashingEmbedder(32)
    rows = search.embed(spark.createDataFrame([(1, "tax cuts"), (2, "health"), (3, None)], "id int, t string"), "t", e)
    assert search.semantic(rows, "tax cuts", e, 1, "id").first()["id"] == 1
    with pytest.raises(ValueError):
        search.semantic(rows, "x", search.HashingEmbedder(16), 1, "id")


def test_filters_reach_the_scan(spark, data):
    df = vectors.top_k(spark.read.parquet(f"{data}/embeddings.parquet"), [0.0] * 64, 3, "vec_id", "embedding", 0.0, F.col("label") == 3)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(label), EqualTo(label,3)]" in plan and "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_cluster_queries_do_the_whole_job(spark, monkeypatch):
    from agora.plans import searches, shaped

    asked = []
    monkeypatch.setattr(vectors, "fuzzy_c_means", lambda v, k, **how: asked.append((k, how)) or (None, {"objective": 0.0, "fpc": 0.0, "mpc": 0.0, "xie_beni": 0.0}))
    monkeypatch.setattr(vectors, "kmeans_scan", lambda v, ks: asked.append(ks) or [{"k": 2, "silhouette": 0.0, "calinski_harabasz": 0.0, "davies_bouldin": 0.0}])
    for run in (searches.v3, shaped.v6, searches.v8):
        run(spark, "/root/testdata/sf0.001")
    assert asked == [(4, {"m": 1.3}), *((k, {"m": 1.3}) for k in range(2, 13)), list(range(2, 31))]


def test_restarts_keep_the_lowest_objective(spark):
    df = spark.createDataFrame([([float(k % 5 * 9), float(k % 7)],) for k in range(60)], "embedding array<double>")
    one, five = (vectors.fuzzy_c_means(df, 5, rounds=2, n_init=n)[1]["objective"] for n in (1, 5))
    assert five <= one


def test_rows_are_dealt_out_before_python_reads_them(spark, data):
    from agora.plans import documents, records  # noqa: F401

    assert records.QUERIES["src13_release_details"](spark, data).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert records.QUERIES["src2_zipped_json"](spark, data).rdd.getNumPartitions() > 1


def test_votes_are_sorted_without_a_lambda(spark, data):
    from agora.plans import records

    assert "sort_array(" in records.QUERIES["a5_voting_profile"](spark, data)._jdf.queryExecution().toString()
