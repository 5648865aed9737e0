import numpy as np
import pytest

from agora.operators import neighbours
from agora.plans import records, searches  # noqa: F401  fills records.QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, k):
    """The k nearest others of each row by rounded cosine distance and id; zero vectors are at distance 1 from all."""
    rows = sorted({(i, tuple(v)) for i, v in rows})
    ids, u = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
    d = np.round(1 - u @ u.T, 6) + 0.0
    return sorted((int(ids[i]), int(ids[j]), r + 1, float(d[i, j])) for i in range(len(ids)) for r, j in enumerate([j for j in np.lexsort((ids, d[i])) if ids[j] != ids[i]][:k]))


def clouds(n, dim=16, groups=12, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.normal(0, 1, (groups, dim))
    return [(int(i), [float(x) for x in middle[i % groups] + rng.normal(0, 0.05, dim)]) for i in rng.permutation(n)]


def found(df):
    return sorted((r.src, r.dst, r["rank"], r.distance + 0.0) for r in df.collect())


@pytest.fixture
def cells(monkeypatch):
    def forced(cell, block):
        monkeypatch.setattr(neighbours, "CELL", cell)
        monkeypatch.setattr(neighbours, "BLOCK", block)

    return forced


@pytest.mark.parametrize(("cell", "block"), [(10_000, 10_000), (40, 10_000), (40, 16)])
def test_cells_and_parts_equal_brute_force(spark, cells, cell, block):
    cells(cell, block)
    rows = clouds(300) + [(1000 + i, [0.0] * 16) for i in range(3)] + [(2000, [-x for x in clouds(1)[0][1]])]
    assert found(neighbours.neighbours(spark.createDataFrame(rows, SCHEMA).repartition(4), 4)) == brute(rows, 4)


@pytest.mark.parametrize("name", ["j13_knn_all_pairs", "j14_knn_mutual_edges"])
def test_queries_equal_sql_over_many_cells(same, cells, name):
    cells(40, 30)
    same(records.QUERIES[name], records.SQL[name])


@pytest.mark.parametrize(("cell", "block"), [(10_000, 10_000), (30, 20)])
def test_groups_of_equal_vectors(spark, cells, cell, block):
    """Half of all rows share a vector, repeated rows count once, and no group is compared pair by pair."""
    cells(cell, block)
    rows = clouds(120)
    rows += [(500 + i, rows[0][1]) for i in range(130)] + rows[:20] + [(900 + i, rows[5][1]) for i in range(3)]
    assert found(neighbours.neighbours(spark.createDataFrame(rows, SCHEMA).repartition(3), 5)) == brute(rows, 5)


def test_clusters_spare_most_pairs(spark, cells):
    cells(60, 10_000)
    rows = clouds(3000, groups=50)
    seen = spark.sparkContext.accumulator(0)
    got = neighbours.neighbours(spark.createDataFrame(rows, SCHEMA).repartition(4), 3, compared=seen)
    assert found(got) == brute(rows, 3)
    assert 0 < seen.value < 3000 * 3000 / 5


def test_left_out_rows_and_few_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [1.0, 0.0])]
    assert found(neighbours.neighbours(spark.createDataFrame(rows, SCHEMA), 4)) == [(1, 2, 1, 0.292893), (2, 1, 1, 0.292893)]
    for few in ([], rows[:1]):
        assert found(neighbours.neighbours(spark.createDataFrame(few, SCHEMA), 4)) == []
    with pytest.raises(ValueError, match="can't be compared"):
        neighbours.neighbours(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA), 1)


@pytest.mark.parametrize(("shelves", "shelf"), [(6, 10_000), (2, 10_000), (1, 90)])
def test_a_vector_is_sent_once_to_a_shelf(spark, cells, monkeypatch, shelves, shelf):
    """Vectors without clusters, to which most of 60 cells are open."""
    cells(10, 10_000)
    monkeypatch.setattr(neighbours, "SHELVES", shelves, raising=False)
    monkeypatch.setattr(neighbours, "SHELF", shelf, raising=False)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 12)]) for i in range(600)]
    sent, plain = spark.sparkContext.accumulator(0), neighbours._second

    def counted(*args):
        run = plain(*args)

        def told(t):
            sent.add(t.num_rows)
            return run(t)

        return told

    monkeypatch.setattr(neighbours, "_second", counted)
    assert found(neighbours.neighbours(spark.createDataFrame(rows, SCHEMA).repartition(4), 5)) == brute(rows, 5)
    most = max(shelves, -(-600 // shelf))
    assert 600 < sent.value <= 600 * most * 2
