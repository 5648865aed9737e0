"""Vector sets: cosine search, exact neighbours, graphs of neighbours, clusters and projections.

Vectors are arrays of floats, computed in doubles. One query against all rows is a plain expression and a top-k; neighbours of all
rows come from agora.operators.neighbours.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.operators.folders import scratch, written
from agora.operators.neighbours import check_dimension, matrix, neighbours  # noqa: F401  used by its callers too
from agora.operators.sums import tree_sum


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays of one length; null if either is of length zero or all zeros."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def unit(a: Column) -> Column:
    n = F.greatest(F.sqrt(dot(a, a)), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / n)


def stacked(blocks: dict[str, DataFrame], vector: str = "embedding") -> DataFrame:
    """The vectors of several blocks one below the other, with block; lengths that differ within one or among them raise."""
    out = None
    for name, df in blocks.items():
        one = df.withColumn("block", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no block to stack")
    check_dimension(out, vector)
    return out


def top_k(vectors: DataFrame, query: list[float], k: int, id: str, vector: str, least: float | None = 0.0, where: Column | None = None) -> DataFrame:
    """(id, score): the k rows most like the query, those under least left out (0.0 is a filter, None is none), ties by id."""
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = vectors if where is None else vectors.where(where)
    scored = rows.select(id, F.round(cosine(F.col(vector), q), 6).alias("score")).where("score is not null")
    return (scored if least is None else scored.where(F.col("score") >= least)).orderBy(F.desc("score"), F.asc(id)).limit(max(1, k))


def neighbour_edges(near: DataFrame, mutual: bool, most: float | None = None) -> DataFrame:
    """(a, b), a < b: pairs of which one is the other's neighbour, or each is the other's (mutual); distances over most go."""
    near = near if most is None else near.where(F.col("distance") <= most)
    pairs = near.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n")).where("n = 2" if mutual else "n >= 1").select("a", "b")


def _checkpoints(spark: SparkSession) -> None:
    """The folder for checkpoints: what the session names, a temporary one only where a session on one machine names none."""
    if spark.sparkContext.getCheckpointDir():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="agora-"))


def components(vertices: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component): the least id that edges (a, b) reach, for each id of vertices. Each round passes labels along edges and
    then to the label's own label, so that rounds grow with the logarithm of the paths."""
    _checkpoints(vertices.sparkSession)
    both = edges.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v").checkpoint()
    now = vertices.select("id", F.col("id").alias("component")).checkpoint()
    for _ in range(rounds):
        told = both.join(now.withColumnRenamed("id", "v"), "v").groupBy("u").agg(F.min("component").alias("m")).withColumnRenamed("u", "id")
        step = now.join(told, "id", "left").select("id", F.least("component", "m").alias("component"))
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("m"))
        after = step.join(jump, "component", "left").select("id", F.least("component", "m").alias("component")).checkpoint()
        changed = after.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0] != now.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        now = after
        if not changed:
            return now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def cluster_labels(parts: DataFrame, least: int) -> DataFrame:
    """(id, cluster): components of least members or more, numbered from 0 by size and then by their least id; the rest is -1."""
    _checkpoints(parts.sparkSession)
    sizes = parts.groupBy("component").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    # Sorted over all tasks and written; each partition is then numbered from where those before it end.
    place = F.monotonically_increasing_id()
    told = sizes.orderBy(F.desc("size"), "component").select("component", F.shiftright(place, 33).alias("p"), place.bitwiseAND((1 << 33) - 1).alias("i")).checkpoint()
    counts, at = sorted((r["p"], r["n"]) for r in told.groupBy("p").agg(F.count("*").alias("n")).collect()), 0  # a row for each partition
    starts = []
    for p, n in counts:
        starts += [F.lit(p), F.lit(at)]
        at += n
    ranked = told.select("component", (F.col("i") + F.element_at(F.create_map(*starts), F.col("p"))).cast("long").alias("cluster")) if starts else told.select("component", F.col("i").alias("cluster"))
    return parts.join(ranked, "component", "left").select("id", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


# Fuzzy c-means. Centres are few and small; points stay on the executors.


def memberships(points: np.ndarray, centres: np.ndarray, m: float) -> np.ndarray:
    d = np.maximum(np.linalg.norm(points[:, None, :] - centres[None, :, :], axis=2), 1e-12)
    w = d ** (-2.0 / (m - 1.0))
    return w / w.sum(1, keepdims=True)


def membership_rows(vectors: DataFrame, centres: list[list[float]], m: float = 2.0, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, memberships): how far each point belongs to each of the given centres, as an expression."""
    if m <= 1:
        raise ValueError("the exponent must exceed 1")
    d2 = [F.greatest(F.aggregate(F.zip_with(F.col(vector), F.array(*(F.lit(float(x)) for x in c)), lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)), F.lit(0.0), lambda t, x: t + x), F.lit(1e-24)) for c in centres]
    rows = vectors.select(id, *(d.alias(f"d{k}") for k, d in enumerate(d2)))
    w = [F.pow(F.col(f"d{k}"), F.lit(-1.0 / (m - 1.0))) for k in range(len(centres))]
    total = sum(w[1:], w[0])
    return rows.select(id, F.array(*(x / total for x in w)).alias("memberships"), F.array(*(F.col(f"d{k}") for k in range(len(centres)))).alias("d2"))


def xie_beni(vectors: DataFrame, centres: list[list[float]], m: float = 2.0, id: str = "vec_id", vector: str = "embedding") -> float:
    """Weighted spread over the least squared distance of centres; infinite for one centre or two that coincide."""
    c = np.array(centres, float)
    apart = min((float(((a - b) ** 2).sum()) for i, a in enumerate(c) for b in c[:i]), default=0.0)
    n, s = membership_rows(vectors, centres, m, id, vector).agg(F.count("*"), F.sum(F.aggregate(F.zip_with("memberships", "d2", lambda u, d: F.pow(u, F.lit(m)) * d), F.lit(0.0), lambda t, x: t + x))).first()
    return float("inf") if apart <= 0 or not n else s / n / apart


def _fcm_step(centres: np.ndarray, before: np.ndarray | None, m: float):
    """Weighted sums and weights for the next centres; cost, the sum of squared memberships, points, and the squared change of
    memberships since the centres before."""

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        k, dim = centres.shape
        total, weight, rest = np.zeros((k, dim)), np.zeros(k), np.zeros(4)
        for batch in batches:
            x = matrix(batch.column("v"))
            if not len(x):
                continue
            u = memberships(x, centres, m)
            w = u**m
            total += w.T @ x
            weight += w.sum(0)
            change = np.inf if before is None else float(((u - memberships(x, before, m)) ** 2).sum())
            rest += [float((w * ((x[:, None, :] - centres[None]) ** 2).sum(2)).sum()), float((u**2).sum()), len(x), change]
        return np.concatenate([total.ravel(), weight, rest])

    return part


def fuzzy_c_means(vectors: DataFrame, k: int, m: float = 2.0, rounds: int = 150, stop: float = 1e-5, seed: int = 0, n_init: int = 1, vector: str = "embedding") -> tuple[np.ndarray, dict[str, float]]:
    """Centres, and their objective, partition coefficient (fpc), its modified form (mpc) and Xie-Beni index.

    A round sends k centres out and brings one sum back; it is over when the root of the squared changes of all memberships is
    under stop. Seeds are drawn from a sample of at most 1000 points, each far from those before; of n_init starts the one of the
    lowest objective counts. The order of tasks does not change a result by more than rounding.
    """
    if m <= 1:
        raise ValueError("the exponent must exceed 1")
    points = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).cache()
    few = np.array([r["v"] for r in points.orderBy(F.xxhash64(F.to_json("v"), F.lit(seed))).limit(1000).collect()], float)
    if len(few) < k:
        raise ValueError("fewer points than centres")
    rng = np.random.default_rng(seed)
    best = None
    for _ in range(max(1, n_init)):
        centres, before = few[[rng.integers(len(few))]], None
        while len(centres) < k:
            d = ((few[:, None, :] - centres[None]) ** 2).sum(2).min(1)
            centres = np.vstack([centres, few[rng.choice(len(few), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(few))]])
        for left in range(rounds, -1, -1):
            got = tree_sum(points, _fcm_step(centres, before, m))
            weight, (cost, fit, n, change) = got[-4 - k : -4], got[-4:]
            if not left or change**0.5 < stop:
                break
            centres, before = got[: -4 - k].reshape(centres.shape) / np.maximum(weight[:, None], 1e-12), centres
        if best is None or cost < best[0]:
            best = cost, fit, n, centres
    cost, fit, n, centres = best
    points.unpersist()
    fpc = fit / max(n, 1)
    apart = min((float(((a - b) ** 2).sum()) for i, a in enumerate(centres) for b in centres[:i]), default=0.0)
    return centres, {"objective": cost, "fpc": fpc, "mpc": (fpc - 1 / k) / (1 - 1 / k) if k > 1 else 0.0, "xie_beni": cost / n / apart if apart > 0 else float("inf")}


def fcm_scan(vectors: DataFrame, most: int | None = None, **how) -> list[dict[str, float]]:
    """Scores for each number of clusters from 2 on; the first best wins where scores tie."""
    n = vectors.count()
    most = most or min(12, max(3, int(n**0.5)))
    return [{"k": k, **fuzzy_c_means(vectors, k, **how)[1]} for k in range(2, min(most, n - 1) + 1)]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors with the hash that draws them, a row for each batch, so that a round reads a few long rows."""
    for batch in batches:
        x = matrix(batch.column("v"))
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([batch.column("h").to_numpy().astype(np.int64).tobytes()], pa.binary())], names=["x", "h"])


def _blocks(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(vectors, hashes), 4,096 at most at a time."""
    for batch in batches:
        for x, h in zip(batch.column("x"), batch.column("h"), strict=True):
            rows, drawn = np.frombuffer(x.as_buffer()).reshape(-1, dim), np.frombuffer(h.as_buffer(), np.int64)
            for a in range(0, len(rows), 4096):
                yield rows[a : a + 4096], drawn[a : a + 4096]


def _apart(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of each vector to each centre."""
    return np.maximum((x**2).sum(1)[:, None] - 2.0 * x @ centres.T + (centres**2).sum(1)[None], 0.0)


def _nearest(x: np.ndarray, fits: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(nearest centre, its squared distance) of each vector, for each fit; one product for all fits."""
    d = _apart(x, np.concatenate(fits))
    for at, c in zip(np.cumsum([0, *map(len, fits)]), fits, strict=False):
        near = d[:, at : at + len(c)].argmin(1)
        yield near, d[np.arange(len(x)), at + near]


def _members(near: np.ndarray, k: int) -> np.ndarray:
    return (near[None] == np.arange(k)[:, None]).astype(float)


def _kmeans_step(fits: list[np.ndarray], dim: int):
    """For each fit the sums and the numbers of its clusters' vectors."""

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = [np.zeros((len(c), dim + 1)) for c in fits]
        for x, _ in _blocks(batches, dim):
            one = np.hstack([x, np.ones((len(x), 1))])
            for t, c, (near, _) in zip(total, fits, _nearest(x, fits), strict=True):
                t += _members(near, len(c)) @ one
        return np.concatenate([t.ravel() for t in total])

    return part


def _seeds(blocks: DataFrame, dim: int, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(candidates, weights) of k-means||: rounds that draw each vector by its squared distance to those drawn, 2 * most in the mean;
    a candidate weighs the vectors nearest to it, of all. What is drawn hangs on the vector's hash, not on its task."""
    first = blocks.mapInArrow(_drawn(None, 0.0, dim, seed, 0), "x binary, u double").orderBy("u", "x").first()
    found = np.frombuffer(first["x"])[None]
    for step in range(1, 12):
        cost = float(tree_sum(blocks, lambda batches, c=found: np.array([sum(float(_apart(x, c).min(1).sum()) for x, _ in _blocks(batches, dim))]))[0])
        if cost <= 1e-12 or step > 2 and len(found) >= most:
            break
        rows = blocks.mapInArrow(_drawn(found, 2.0 * most / cost, dim, seed, step), "x binary, u double").select("x").distinct().collect()  # 2 * most in the mean
        if rows:
            found = np.unique(np.vstack([found, *(np.frombuffer(r["x"])[None] for r in rows)]), axis=0)
    return found, tree_sum(blocks, _kmeans_step([found], dim)).reshape(len(found), dim + 1)[:, dim]


def _drawn(centres: np.ndarray | None, factor: float, dim: int, seed: int, step: int):
    """Vectors whose number, from 0 to 1 by hash, is under factor times their squared distance; without centres a task's least number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = None
        for x, h in _blocks(batches, dim):
            z = h.astype(np.uint64) + np.uint64((seed * 16 + step + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            for by, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                z = (z ^ (z >> np.uint64(by))) * np.uint64(m)
            u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53
            if centres is None:
                i = int(u.argmin())
                least = min(least or (2.0, b""), (float(u[i]), x[i].tobytes()))
                continue
            d = _apart(x, centres).min(1)
            some = np.flatnonzero((d > 1e-12) & (u < factor * d))
            yield pa.RecordBatch.from_arrays([pa.array([x[i].tobytes() for i in some], pa.binary()), pa.array(u[some], pa.float64())], names=["x", "u"])
        if least:
            yield pa.RecordBatch.from_arrays([pa.array([least[1]], pa.binary()), pa.array([least[0]], pa.float64())], names=["x", "u"])

    return run


def _start(found: np.ndarray, weight: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k of the candidates (all, if fewer) by weighted k-means++, then moved by rounds over the weighted candidates."""
    if len(found) <= k:
        return found
    rng = np.random.default_rng(seed)
    centres = found[[rng.choice(len(found), p=weight / weight.sum())]]
    while len(centres) < k:
        d = _apart(found, centres).min(1) * np.maximum(weight, 1e-9)
        centres = np.vstack([centres, found[rng.choice(len(found), p=d / d.sum()) if d.sum() > 0 else len(centres)]])
    for _ in range(30):
        one = _members(_apart(found, centres).argmin(1), k) * weight
        held = one.sum(1)
        centres = np.where(held[:, None] > 0, one @ found / np.maximum(held, 1e-12)[:, None], centres)
    return centres


def _scored(fits: list[np.ndarray], dim: int, units: list[np.ndarray] | None = None, sizes: list[np.ndarray] | None = None):
    """For each fit and cluster the number of vectors, their squared distances and distances, and the sum of unit vectors; with the
    latter as units and sizes, the sum of silhouettes by cosine for each fit."""

    def part(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = [np.zeros((len(c), dim + 3)) for c in fits] if units is None else np.zeros(len(fits))
        for x, _ in _blocks(batches, dim):
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            unit = x / np.where(norm > 0, norm, 1.0)
            for j, (c, (near, d2)) in enumerate(zip(fits, _nearest(x, fits), strict=True)):
                if units is None:
                    total[j] += _members(near, len(c)) @ np.hstack([np.ones((len(x), 1)), d2[:, None], np.sqrt(d2)[:, None], unit])
                    continue
                n, at = sizes[j], np.arange(len(x))
                far = np.where(n > 0, 1.0 - unit @ units[j].T / np.maximum(n, 1), np.inf)
                own = far[at, near] * n[near] / np.maximum(n[near] - 1, 1)
                far[at, near] = np.inf
                other = far.min(1)
                more = np.maximum(own, other)
                total[j] += float(np.where((n[near] > 1) & (more > 0) & np.isfinite(other), (other - own) / np.where(more > 0, more, 1.0), 0.0).sum())
        return np.concatenate([t.ravel() for t in total]) if units is None else total

    return part


def kmeans_fits(vectors: DataFrame, ks: list[int], seed: int = 0, rounds: int = 300, stop: float = 1e-4, vector: str = "embedding") -> list[dict[str, object]]:
    """For each number of clusters its k, centres, inertia, silhouette (cosine), Calinski-Harabasz and Davies-Bouldin.

    All fits go on together: a round is one pass over the vectors for those that still move, until no centre of a fit moves by more
    than stop. Starts are drawn from all vectors by k-means||, and hang on neither the order of vectors nor their partitions.
    Empty clusters keep their centre, fewer distinct vectors than k give fewer clusters, and zero vectors are at cosine distance 1.
    The driver gets sums of clusters; vectors stay on the executors."""
    points = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    dim = check_dimension(points, "v")
    if not dim:
        return []
    path = scratch(vectors.sparkSession, "kmeans")
    rows = points.select("v", F.xxhash64(F.to_json("v")).alias("h")).repartition(vectors.sparkSession.sparkContext.defaultParallelism)
    blocks = written(rows.mapInArrow(_packed, "x binary, h binary"), path).cache()
    found, weight = _seeds(blocks, dim, max(ks), seed)
    fits = [_start(found, weight, k, seed) for k in ks]
    moving = list(range(len(ks)))
    for _ in range(rounds):
        got, at, still = tree_sum(blocks, _kmeans_step([fits[j] for j in moving], dim)), 0, []
        for j in moving:
            size = len(fits[j]) * (dim + 1)
            sums, at = got[at : at + size].reshape(-1, dim + 1), at + size
            after = np.where(sums[:, dim:] > 0, sums[:, :dim] / np.maximum(sums[:, dim:], 1.0), fits[j])
            if ((after - fits[j]) ** 2).sum(1).max() > stop * stop:
                still.append(j)
            fits[j] = after
        moving = still
        if not moving:
            break
    got, at, stats = tree_sum(blocks, _scored(fits, dim)), 0, []
    for c in fits:
        stats.append(got[at : at + len(c) * (dim + 3)].reshape(len(c), dim + 3))
        at += len(c) * (dim + 3)
    silhouettes = tree_sum(blocks, _scored(fits, dim, [s[:, 3:] for s in stats], [s[:, 0] for s in stats]))
    n, mean = weight.sum(), None
    blocks.unpersist()
    out = []
    for k, centres, s, sil in zip(ks, fits, stats, silhouettes, strict=True):
        size, within, held = s[:, 0], float(s[:, 1].sum()), np.flatnonzero(s[:, 0])
        mean = size @ centres / n if mean is None else mean
        between, spread = float(size @ ((centres - mean) ** 2).sum(1)), s[:, 2] / np.maximum(size, 1)
        several = len(held) > 1
        db = float(np.mean([max((spread[i] + spread[j]) / max(float(np.linalg.norm(centres[i] - centres[j])), 1e-12) for j in held if j != i) for i in held])) if several else float("nan")
        ch = between / (k - 1) / (within / (n - k)) if within > 0 and n > k > 1 else float("nan")
        out.append({"k": k, "centres": centres, "inertia": within, "silhouette": float(sil / n) if several else float("nan"), "calinski_harabasz": ch, "davies_bouldin": db})
    return out


def kmeans_scan(vectors: DataFrame, ks: list[int], seed: int = 0, vector: str = "embedding") -> list[dict[str, float]]:
    """Silhouette (cosine), Calinski-Harabasz and Davies-Bouldin for each number of clusters."""
    return [{c: r[c] for c in ("k", "silhouette", "calinski_harabasz", "davies_bouldin")} for r in kmeans_fits(vectors, ks, seed, vector=vector)]


def project(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, x, y): the two leading principal components of centred vectors. The sign makes the largest loading positive.

    Means and the covariance, numbers of the dimension squared, are summed on the executors; rows are then projected by an expression.
    One row is at the origin, no rows give none."""
    points = vectors.where(F.col(vector).isNotNull()).select(id, F.col(vector).cast("array<double>").alias("v"))
    dim = check_dimension(points, "v")
    if not dim:
        return points.select(id, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    sums = tree_sum(points.select("v"), _moments)
    n, total, second = sums[0], sums[1 : dim + 1], sums[dim + 1 :].reshape(dim, dim)
    mean, second = total / n, second / n
    _, vec = np.linalg.eigh(second - np.outer(mean, mean))
    axes = vec[:, ::-1][:, : min(2, dim)].T
    axes = [a * np.sign(a[np.abs(a).argmax()]) for a in axes] + [np.zeros(dim)] * (2 - len(axes))
    at = lambda a: dot(F.col("v"), F.array(*(F.lit(float(x)) for x in a))) - F.lit(float(a @ mean))
    return points.select(id, at(axes[0]).alias("x"), at(axes[1]).alias("y"))


def _moments(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
    """The number of points, their sum and that of their products."""
    total = None
    for batch in batches:
        x = matrix(batch.column("v"))
        if len(x):
            got = np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()])
            total = got if total is None else total + got
    return total


def projected_centres(points: DataFrame, labels: DataFrame, visible: list[int] | None = None, m: float = 2.0, id: str = "vec_id") -> list[list[float]]:
    """Centres in the plane: means of the points (id, x, y) weighted by labels (id, cluster, memberships) to the power of m.

    visible keeps the points of these clusters; memberships in others count as none, and the rest is scaled to 1."""
    rows = points.join(labels.select(id, "cluster", "memberships"), id)
    if visible:
        rows = rows.where(F.col("cluster").isin(visible))
        u = F.transform("memberships", lambda x, i: F.when(i.isin(visible), x).otherwise(0.0))
        total = F.greatest(F.aggregate(u, F.lit(0.0), lambda t, x: t + x), F.lit(1e-12))
        rows = rows.withColumn("memberships", F.transform(u, lambda x: x / total))
    k = labels.agg(F.max(F.size("memberships"))).first()[0] or 0
    w = [F.pow(F.greatest(F.get("memberships", F.lit(j)), F.lit(1e-12)), F.lit(m)) for j in range(k)]
    sums = rows.agg(F.count("*"), *(F.sum(x) for j in range(k) for x in (w[j], w[j] * F.col("x"), w[j] * F.col("y")))).first()
    return [[sums[3 * j + 2] / max(sums[3 * j + 1], 1e-12), sums[3 * j + 3] / max(sums[3 * j + 1], 1e-12)] for j in range(k)] if sums[0] else []


def uncertainty_grid(points: DataFrame, centres: list[list[float]], steps: int = 180, m: float = 2.0) -> DataFrame:
    """(x, y, uncertainty, cluster) on a grid of steps x steps places over the points' extent, padded by 8 percent."""
    x0, x1, y0, y1 = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    line = lambda a, b: (a - 0.08 * (b - a) - 1e-6, (1.16 * (b - a) + 2e-6) / max(1, steps - 1))
    (ax, dx), (ay, dy) = line(x0 or 0.0, x1 or 0.0), line(y0 or 0.0, y1 or 0.0)
    cells = points.sparkSession.range(steps * steps).select(F.expr(f"id % {steps}").alias("i"), F.expr(f"id div {steps}").alias("j"))
    grid = cells.select((F.lit(ax) + F.col("i") * dx).alias("x"), (F.lit(ay) + F.col("j") * dy).alias("y"))
    if len(centres) < 2:
        return grid.select("x", "y", F.lit(0.0).alias("uncertainty"), F.lit(0).alias("cluster"))
    u = membership_rows(grid.select(F.struct("x", "y").alias("id"), F.array("x", "y").alias("v")), centres, m, "id", "v")
    top = F.array_max("memberships")
    return u.select("id.x", "id.y", (1 - top).alias("uncertainty"), (F.array_position("memberships", top) - 1).cast("int").alias("cluster"))


def top_memberships(u: Column, n: int = 3) -> Column:
    """"C2:0.913, ...": the n largest memberships, of equal ones the lower number first."""
    pairs = F.transform(u, lambda x, i: F.struct((-F.round(x, 12)).alias("a"), i.alias("i"), x.alias("x")))
    return F.array_join(F.transform(F.slice(F.array_sort(pairs), 1, n), lambda p: F.format_string("C%d:%.3f", p["i"], p["x"])), ", ")
