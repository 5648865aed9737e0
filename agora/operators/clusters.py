"""Clusterings of vectors with their number chosen by a score: labels, confidence, warnings, thresholds of distance."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.operators import counts, vectors
from agora.operators.folders import scratch, written

#: Scores by which a number of clusters is chosen, and whether the most or the least is best.
BEST = {"xie_beni": min, "mpc": max, "fpc": max, "silhouette": max, "calinski_harabasz": max, "davies_bouldin": min}


def best_of(rows: list[dict[str, float]], score: str) -> int | None:
    """The number of clusters with the best score, of equal ones the first; what is no number never wins. None if none is left."""
    known = [r for r in rows if not math.isnan(r[score])]
    return int(BEST[score](known, key=lambda r: r[score])["k"]) if known else None


def fuzzy_labels(points: DataFrame, k: int | None = None, score: str = "xie_beni", m: float = 2.0, id: str = "vec_id", vector: str = "embedding", **how) -> tuple[DataFrame, dict[str, object]]:
    """((id, cluster, confidence, uncertainty, memberships, top3), what is known of the fit).

    Without k the best by score is taken. The fit holds k, its scores, and collapsed: whether two centres coincide or the mean
    confidence is hardly above that of equal memberships. Under 4 points nothing is clustered: all are in cluster 0, certain.
    """
    n = points.where(F.col(vector).isNotNull()).count()
    if n < 4:
        one = points.where(F.col(vector).isNotNull()).select(id, F.lit(0).alias("cluster"), F.lit(1.0).alias("confidence"), F.lit(0.0).alias("uncertainty"), F.array(F.lit(1.0)).alias("memberships"), F.lit("-").alias("top3"))
        return one, {"k": 1, "collapsed": False}
    k = min(k, max(2, n - 1)) if k else best_of(vectors.fcm_scan(points, m=m, vector=vector, **how), score)
    centres, scores = vectors.fuzzy_c_means(points, k, m=m, vector=vector, **how)
    top = F.array_max("memberships")
    rows = vectors.membership_rows(points.where(F.col(vector).isNotNull()), centres.tolist(), m, id, vector).select(
        id, (F.array_position("memberships", top) - 1).cast("int").alias("cluster"), top.alias("confidence"), (1 - top).alias("uncertainty"), "memberships", vectors.top_memberships(F.col("memberships")).alias("top3")
    )
    apart = min((float(np.linalg.norm(a - b)) for i, a in enumerate(centres) for b in centres[:i]), default=math.inf)
    mean = rows.agg(F.avg("confidence")).first()[0]
    return rows, {"k": k, **scores, "separation": apart, "mean_confidence": mean, "collapsed": apart < 1e-6 or mean <= 1 / k + 0.02}


def kmeans_labels(points: DataFrame, k: int | None = None, score: str = "silhouette", seed: int = 0, id: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, dict[str, object]]:
    """((id, cluster), {k, inertia}); without k the best by score, of 2 to the lesser of 30 and the root of the points plus 8."""
    rows = points.where(F.col(vector).isNotNull())
    n = rows.count()
    ks = [min(k, max(2, n - 1))] if k else list(range(2, min(30, max(3, int(n**0.5) + 8), max(2, n - 1)) + 1))
    fits = vectors.kmeans_fits(rows, ks, seed, vector=vector)
    if not fits:
        return rows.select(id, F.lit(0).alias("cluster")), {"k": k or 2, "inertia": 0.0}
    best = k and ks[0] or best_of(fits, score) or 2
    fit = fits[ks.index(best)]

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = vectors.matrix(batch.column("v"))
            near = next(vectors._nearest(x, [fit["centres"]]))[0] if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(id), pa.array(near.astype(np.int32))], names=[id, "cluster"])

    labels = rows.select(id, F.col(vector).cast("array<double>").alias("v")).mapInArrow(assigned, f"`{id}` {dict(rows.dtypes)[id]}, cluster int")
    return labels, {"k": best, "inertia": fit["inertia"]}


def distance_limit(near: DataFrame, how: str | float | None = None, percent: float = 90.0) -> float | None:
    """The greatest distance at which neighbours (src, dst, distance) are joined: None for no limit, a number as it is,
    "percentile" that of all distances."""
    if how == "percentile":
        return counts.quantile(near, "distance", percent / 100).first()["quantile"]
    return None if how in (None, "none") else float(how)


def graph_labels(points: DataFrame, k: int = 5, how: str | float | None = None, percent: float = 90.0, mutual: bool = True, least: int = 2, id: str = "vec_id") -> DataFrame:
    """(id, cluster) of the graph of neighbours under a limit of distance; components under least members are -1."""
    near = vectors.neighbours(points, k, id)
    if how == "percentile":  # read twice
        near = written(near, scratch(points.sparkSession, "near"))
    edges = vectors.neighbour_edges(near, mutual, distance_limit(near, how, percent))
    return vectors.cluster_labels(vectors.components(points.select(F.col(id).alias("id")), edges), least)


def guard(points: DataFrame, folder: str | None = None, vector: str = "embedding") -> tuple[int, list[str]]:
    """(dimension, warnings): vectors of different lengths raise; more than one source folder is a warning only."""
    dim = vectors.check_dimension(points, vector)
    folders = [r[0] for r in points.select(folder).where(F.col(folder).isNotNull()).distinct().orderBy(folder).limit(10).collect()] if folder else []
    return dim, [f"vectors of several sources: {', '.join(map(str, folders))}"] if len(folders) > 1 else []
