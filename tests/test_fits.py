"""Fits and projections against plain numpy over all points."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.operators import clusters, sums, vectors
from agora.plans import documents, records, searches  # noqa: F401  fills records.QUERIES


@pytest.fixture(scope="module")
def points(spark, data):
    rows = spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()
    return [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)


def soft(x, centres, m):
    d = np.maximum(np.sqrt(((x[:, None] - np.array(centres)[None]) ** 2).sum(2)), 1e-12)
    w = d ** (-2 / (m - 1))
    return w / w.sum(1, keepdims=True)


@pytest.mark.parametrize("parts", [1, 5, 500])
def test_driver_gets_one_array(spark, monkeypatch, parts):
    df = spark.range(2000).repartition(parts).select("id")
    got, plain = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: got.append(plain(self)) or got[-1])
    total = sums.tree_sum(df, lambda batches: np.array([x for b in batches for x in [[b.num_rows, sum(b.column("id").to_pylist())]]]).reshape(-1, 2).sum(0))
    assert total.tolist() == [2000.0, 1999000.0] and [len(x) for x in got] == [1]
    assert sums.tree_sum(df, lambda batches: None) is None


def test_projection_does_not_depend_on_partitions(spark, data, points):
    ids, x = points
    c = x - x.mean(0)
    _, _, v = np.linalg.svd(c, full_matrices=False)
    axes = [a * np.sign(a[np.abs(a).argmax()]) for a in v[:2]]
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    for df in (e, e.repartition(40)):
        got = {r.vec_id: (r.x, r.y) for r in vectors.project(df).collect()}
        assert np.allclose([got[i] for i in ids], np.stack([c @ a for a in axes], 1), atol=1e-6)


def test_fuzzy_fit_stops_when_memberships_stand_still(spark, data, points):
    _, x = points
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    centres, scores = vectors.fuzzy_c_means(e, 4, m=1.3)
    u = soft(x, centres, 1.3)
    after = (u**1.3).T @ x / (u**1.3).sum(0)[:, None]
    assert np.sqrt(((soft(x, after, 1.3) - u) ** 2).sum()) < 1e-4
    assert scores["objective"] == pytest.approx(((u**1.3) * ((x[:, None] - centres[None]) ** 2).sum(2)).sum()) and scores["fpc"] == pytest.approx((u**2).sum() / len(x))
    # One round from the same start is the plain update of its seeds.
    seeds, _ = vectors.fuzzy_c_means(e, 4, m=1.3, rounds=0)
    one, _ = vectors.fuzzy_c_means(e, 4, m=1.3, rounds=1)
    w = soft(x, seeds, 1.3) ** 1.3
    assert np.allclose(one, w.T @ x / w.sum(0)[:, None])


def test_uncertainty_grid_of_visible_clusters(spark, data, points):
    ids, x = points
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    labels, _ = clusters.fuzzy_labels(e, 4, m=1.3)
    at, u = {r.vec_id: (r.x, r.y) for r in vectors.project(e).collect()}, {r.vec_id: r.memberships for r in labels.collect()}
    seen = [i for i in ids if int(np.argmax(u[i])) != 3]
    p, w = np.array([at[i] for i in seen]), np.array([u[i] for i in seen])
    w[:, 3] = 0
    w = np.maximum(w / w.sum(1, keepdims=True), 1e-12) ** 1.3
    middle = w.T @ p / np.maximum(w.sum(0), 1e-12)[:, None]
    assert np.allclose(vectors.projected_centres(vectors.project(e), labels, [0, 1, 2], 1.3), middle)
    lines = [np.linspace(a - (b - a) * 0.08 - 1e-6, b + (b - a) * 0.08 + 1e-6, 180) for a, b in zip(p.min(0), p.max(0), strict=True)]
    cells = np.array([(a, b) for b in lines[1] for a in lines[0]])
    want = soft(cells, middle, 1.3)
    got = sorted((r.y, r.x, r.uncertainty, r.cluster) for r in records.QUERIES["v12_uncertainty_grid"](spark, data).collect())
    assert len(got) == 32_400
    got = np.array(got)
    order = np.lexsort((cells[:, 0], cells[:, 1]))
    assert np.allclose(got[:, [1, 0]], cells[order], atol=1e-6) and np.allclose(got[:, 2], 1 - want.max(1)[order], atol=1e-5)
    sure = np.sort(want, 1)[order][:, -1] - np.sort(want, 1)[order][:, -2] > 1e-6
    assert (got[sure, 3] == want.argmax(1)[order][sure]).all()


def test_no_visible_point(spark):
    none = spark.createDataFrame([], "vec_id long, x double, y double")
    labels = spark.createDataFrame([], "vec_id long, cluster int, memberships array<double>")
    assert vectors.projected_centres(none, labels) == []
    assert vectors.uncertainty_grid(none, [], 3).select("uncertainty").distinct().collect()[0][0] == 0.0


def test_labels_of_kmeans_and_graphs(spark, data, points):
    ids, x = points
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    rows, fit = clusters.kmeans_labels(e, 5)
    label = {r.vec_id: r.cluster for r in rows.collect()}
    of = np.array([label[i] for i in ids])
    middle = np.array([x[of == k].mean(0) for k in range(fit["k"])])
    assert fit["inertia"] == pytest.approx(((x - middle[of]) ** 2).sum(), rel=1e-4)
    assert (((x[:, None] - middle[None]) ** 2).sum(2).argmin(1) == of).mean() > 0.999
    g = {r.id: r.cluster for r in clusters.graph_labels(e, 5, least=3).collect()}
    n = {r.id: r.cluster for r in records.QUERIES["v10_knn_components"](spark, data).collect()}
    assert g == n and e.where(F.col("vec_id").isNull()).count() == 0


def test_fits_of_kmeans_go_on_together(spark, data, points):
    """A round is one pass for all numbers of clusters; starts come from all vectors, however they are dealt out."""
    _, x = points
    e = spark.read.parquet(f"{data}/embeddings.parquet")
    sc = spark.sparkContext
    sc.setJobGroup("fits", "kmeans")
    fits = vectors.kmeans_fits(e, list(range(2, 9)))
    assert len(sc.statusTracker().getJobIdsForGroup("fits")) < 700
    sc._jsc.clearJobGroup()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    far = 1 - unit @ unit.T
    for f, again in zip(fits, vectors.kmeans_fits(e.repartition(9), list(range(2, 9))), strict=True):
        d = ((x[:, None] - f["centres"][None]) ** 2).sum(2)
        near = d.argmin(1)
        assert np.allclose([x[near == j].mean(0) for j in range(f["k"])], f["centres"], atol=1e-3)
        assert f["inertia"] == pytest.approx(d.min(1).sum()) and again["inertia"] == pytest.approx(f["inertia"], rel=1e-6)
        mean = np.array([far[:, near == j].sum(1) / max((near == j).sum(), 1) for j in range(f["k"])]).T
        size = np.bincount(near, minlength=f["k"])[near]
        own = mean[np.arange(len(x)), near] * size / np.maximum(size - 1, 1)
        mean[np.arange(len(x)), near] = np.inf
        want = np.where(size > 1, (mean.min(1) - own) / np.maximum(mean.min(1), own), 0.0).mean()
        assert f["silhouette"] == pytest.approx(want, abs=1e-6)


def test_kmeans_of_few_and_equal_vectors(spark):
    shape = "vec_id long, embedding array<double>"
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], shape)
    assert [len(f["centres"]) for f in vectors.kmeans_fits(same, [2, 3])] == [1, 1]
    assert {r.cluster for r in clusters.kmeans_labels(same)[0].collect()} == {0}
    assert vectors.kmeans_scan(spark.createDataFrame([], shape), [2]) == []
    two = vectors.kmeans_fits(spark.createDataFrame([(1, [0.0, 0.0]), (2, [4.0, 0.0]), (3, [4.0, 1.0])], shape), [2])[0]
    assert sorted(two["centres"].tolist()) == [[0.0, 0.0], [4.0, 0.5]] and two["inertia"] == pytest.approx(0.5)
