import hashlib
import random

import numpy as np
import pytest

from agora.llm import centroids
from agora.llm.queries import ORACLES, QUERIES

SCHEMA = "vec_id long, embedding array<float>, cluster string, distance int, label int"


def brute(rows, k=16, rounds=3, dim=64):
    kept = [(i, [int(np.floor(64.0 * float(np.float32(x)))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    cs = [list(v) for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        parts = {}
        for _, v in kept:
            parts.setdefault(near(v)[1], []).append(v)
        for j, vs in parts.items():
            cs[j] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    got = [(i, *near(v)) for i, v in kept]
    each = {j: sum(d for _, d, x in got if x == j) for j in range(k)}
    return sorted(((i, j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, d, j in got), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def cloud(n, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 0.4, (9, 64))
    return [(i, [float(x) for x in (middle[i % 9] + rng.normal(0, 0.05, 64)).astype(np.float32)], "x", 1, 2) for i in range(n)]


def test_query_equals_sql(same):
    same(QUERIES["op12_centroid_clusters"], ORACLES["op12_centroid_clusters"])


def test_many_trees_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(centroids, "POINTS", 50)
    rows = cloud(400)
    assert found(centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3))) == brute(rows)


def test_odd_rows(spark):
    rows = cloud(40)
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [0.5] * 63, [float("nan")] + [0.5] * 63, [float("inf")] + [0.5] * 63]
    rows += [(100 + i, v, None, None, None) for i, v in enumerate(bad)] + [(None, [0.25] * 64, None, None, None)] * 2 + rows[:9] + [(7, [-0.5] * 64, "", 0, 0)]
    assert found(centroids.cluster(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float(random.Random(i).choice((0, 1))) / 64] * 64, "", 0, 0) for i in range(60)]
    assert found(centroids.cluster(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = cloud(5)
    assert found(centroids.cluster(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    assert centroids.cluster(spark.createDataFrame([], SCHEMA)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, None, "", 0, 0)], SCHEMA)).collect() == []


def test_numbers_beyond_doubles(spark):
    rows = cloud(30) + [(200 + i, [float(np.float32(s * 3e6 * (i + 1)))] * 64, "", 0, 0) for i, s in enumerate((1, -1, 1))]
    assert found(centroids.cluster(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    huge = spark.createDataFrame([(1, [1e20] * 64, "", 0, 0), (2, [-1e20] * 64, "", 0, 0)], SCHEMA)
    assert {tuple(r)[1:5] for r in centroids.cluster(huge, k=1, rounds=1).collect()} == {(0, None, None, None)}
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e30] * 64, "", 0, 0)], SCHEMA))


def test_pruning_spares_points():
    rows = np.floor(64 * np.array([r[1] for r in cloud(4000)]))
    order, nodes = centroids.grown(rows)
    tree = {"points": rows[order], **nodes}
    whole, (at, _) = centroids.filtered(tree, np.array([rows[i] for i in range(9)], float))
    assert len(at) + sum(int((tree["end"][n] - tree["start"][n]).sum()) for n, _ in whole) == 4000
    assert len(at) < 1000
