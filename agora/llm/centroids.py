"""Centroid clustering by kd-tree filtering, exact in whole numbers.

Vectors become whole numbers once and are written as kd-trees, one for each POINTS vectors of a partition, so that a task holds one
tree at a time. A tree's nodes hold the count, the sum and the box of their points. A round sends the centroids to all trees: at each
node, a centroid that is strictly farther than another from every point of the box is pruned; a node with one centroid left is
assigned whole, by its count and sum; the points of leaves with several left are compared with these. Ties are never pruned, so the
smaller number wins them at the leaves. The driver gets one row for each centroid and round, summed on the executors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.llm.shared import cut, drop

#: Vectors of a tree, and of a leaf at most.
POINTS, LEAF = 8192, 32
#: Whole numbers up to here have squared distances that doubles hold exactly; larger ones are compared as Python's.
EXACT = 1 << 22
#: Components of larger size are refused: their sums would not fit in 38 digits.
MOST = 1 << 89

_TREE = T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), *(T.StructField(x, T.BinaryType()) for x in ("points", "start", "end", "child", "low", "high", "sums"))])


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has dim components, none null, NaN or infinite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & ~bad, F.lit(False))


def grown(x: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order of the points of x in its kd-tree, and the nodes from the root down: the points start to end, the box low to high,
    the sums, and the place of the first of two children (0 for leaves). Nodes split at the median of their widest dimension."""
    order, nodes, at = np.arange(len(x)), [[0, len(x), 0]], 0
    low, high, sums = [], [], []
    while at < len(nodes):
        a, b, _ = nodes[at]
        part = x[order[a:b]]
        low.append(part.min(0))
        high.append(part.max(0))
        sums.append(part.sum(0))
        wide = int((high[-1] - low[-1]).argmax())
        if b - a > LEAF and high[-1][wide] > low[-1][wide]:
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, wide], mid)]
            nodes[at][2] = len(nodes)
            nodes += [[a, a + mid, 0], [a + mid, b, 0]]
        at += 1
    start, end, child = np.array(nodes, np.int32).T
    return order, {"start": start, "end": end, "child": child, "low": np.array(low), "high": np.array(high), "sums": np.array(sums)}


def _trees(dim: int, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = [], [], 0

        def tree() -> pa.RecordBatch:
            x = np.concatenate(parts)
            if np.abs(x).max() >= MOST:
                raise ValueError(f"components of {MOST / scale:.3g} or more are too large to add up")
            order, nodes = grown(x)
            cells = {"points": x[order], **nodes}
            arrays = [pa.array([pa.concat_arrays(ids).take(pa.array(order)).to_pylist()], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(arrays + [pa.array([cells[f.name].tobytes()], pa.binary()) for f in _TREE.fields[1:]], names=_TREE.names)

        for batch in batches:
            x = np.floor(batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim) * scale)
            at = 0
            while at < len(x):
                n = min(POINTS - held, len(x) - at)
                ids.append(batch.column("id").slice(at, n))
                parts.append(x[at : at + n])
                at, held = at + n, held + n
                if held == POINTS:
                    yield tree()
                    ids, parts, held = [], [], 0
        if held:
            yield tree()

    return run


def _opened(batch: pa.RecordBatch, i: int, dim: int) -> dict[str, np.ndarray]:
    got = {k: np.frombuffer(batch.column(k)[i].as_buffer(), np.int32 if k in ("start", "end", "child") else float) for k in _TREE.names[1:]}
    return {k: v if v.dtype == np.int32 else v.reshape(-1, dim) for k, v in got.items()}


def filtered(tree: dict[str, np.ndarray], c: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], tuple[np.ndarray, np.ndarray]]:
    """Nodes assigned whole, with their centroids, level by level; and the points left at leaves, with the centroids left for each."""
    whole, leaves, masks = [], [np.zeros(0, np.int64)], [np.zeros((0, len(c)), bool)]
    at, left = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
    norm = (c * c).sum(1)
    while len(at):
        low, high = tree["low"][at], tree["high"][at]
        middle = (low + high) / 2
        near = np.where(left, norm[None] - 2 * middle @ c.T, np.inf).argmin(1)
        toward = c[None] - c[near][:, None]  # from the nearest centroid to each other one
        corner = np.where(toward > 0, high[:, None], low[:, None])  # the box's point that favours the other one most
        left = left & ~(norm[None] - norm[near][:, None] - 2 * (corner * toward).sum(2) > 0)
        one = left.sum(1) == 1
        whole.append((at[one], left[one].argmax(1)))
        at, left = at[~one], left[~one]
        child = tree["child"][at]
        end = child == 0
        for node, mask in zip(at[end], left[end], strict=True):
            a, b = tree["start"][node], tree["end"][node]
            leaves.append(np.arange(a, b))
            masks.append(np.broadcast_to(mask, (b - a, len(c))))
        at, left = np.concatenate([child[~end], child[~end] + 1]).astype(np.int64), np.concatenate([left[~end], left[~end]])
    return whole, (np.concatenate(leaves), np.concatenate(masks))


def _nearest(x: np.ndarray, c: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.where(mask, (c * c).sum(1)[None] - 2 * x @ c.T, np.inf).argmin(1)


def _plain(x: np.ndarray, centroids: list[list[int]]) -> Iterator[tuple[int, int, list[int]]]:
    """For each point its centroid, distance and components as Python's whole numbers, where doubles are not exact."""
    for row in x:
        p = [int(v) for v in row]
        d, k = min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), k) for k, c in enumerate(centroids))
        yield k, d, p


def _fits(tree: dict[str, np.ndarray], centroids: list[list[int]]) -> bool:
    return max(-tree["low"][0].min(), tree["high"][0].max(), *(abs(v) for c in centroids for v in c)) <= EXACT


def _summed(centroids: list[list[int]]):
    """One row for each centroid and task: how many points it has, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = len(centroids), len(centroids[0])
        n, sums = [0] * k, [[0] * dim for _ in range(k)]
        for batch in batches:
            for i in range(batch.num_rows):
                tree = _opened(batch, i, dim)
                if not _fits(tree, centroids):
                    for j, _, p in _plain(tree["points"], centroids):
                        n[j] += 1
                        sums[j] = [a + b for a, b in zip(sums[j], p, strict=True)]
                    continue
                c, counts, total = np.array(centroids, float), np.zeros(k, np.int64), np.zeros((k, dim))
                whole, (at, mask) = filtered(tree, c)
                for nodes, j in whole:
                    np.add.at(counts, j, tree["end"][nodes] - tree["start"][nodes])
                    np.add.at(total, j, tree["sums"][nodes])
                j = _nearest(tree["points"][at], c, mask)
                np.add.at(counts, j, 1)
                np.add.at(total, j, tree["points"][at])
                n = [a + int(b) for a, b in zip(n, counts, strict=True)]
                sums = [[a + int(b) for a, b in zip(old, new, strict=True)] for old, new in zip(sums, total, strict=True)]
        used = [j for j in range(k) if n[j]]
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([n[j] for j in used], pa.int64()), pa.array([[Decimal(v) for v in sums[j]] for j in used], pa.list_(pa.decimal128(38, 0)))], names=["cluster", "n", "sums"])

    return run


def _assigned(centroids: list[list[int]]):
    """Each vector's centroid and squared distance, null if beyond 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim = len(centroids[0])
        for batch in batches:
            for i in range(batch.num_rows):
                tree, ids = _opened(batch, i, dim), batch.column("ids")[i].values
                if _fits(tree, centroids):
                    c, x = np.array(centroids, float), tree["points"]
                    j = np.zeros(len(x), np.int32)
                    whole, (at, mask) = filtered(tree, c)
                    for nodes, which in whole:
                        for node, k in zip(nodes, which, strict=True):
                            j[tree["start"][node] : tree["end"][node]] = k
                    j[at] = _nearest(x[at], c, mask)
                    d = ((x - c[j]) ** 2).sum(1).astype(np.int64).tolist()
                else:
                    found = list(_plain(tree["points"], centroids))
                    j, d = np.array([f[0] for f in found], np.int32), [f[1] if f[1] < 1 << 63 else None for f in found]
                yield pa.RecordBatch.from_arrays([ids, pa.array(j, pa.int32()), pa.array(d, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, salt: str = "1", id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for each usable vector, its components floor(scale * x).

    The k vectors with the least sha256 of "salt:id" are the first centroids; each round assigns all vectors to the nearest (ties: the
    smaller number) and moves each centroid that has any to floor(sum / count). Vectors that are null, of another length or with
    null, NaN or infinite components are left out; a table without usable ones gives no rows, fewer than k as many centroids.
    Repeated rows count one by one, and the first centroids that share an id stand in the order of their components. Rows without an id
    take part, and come last as first centroids. Other columns are not read. A distance or sum beyond 64 bits is null; components
    times scale of 2**89 or more raise.
    """
    v = F.col(f"`{vector}`")
    kept = vectors.where(usable(v, dim)).select(F.col(f"`{id}`").cast("long").alias("id"), v.cast("array<double>").alias("v"))
    first = kept.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256).alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    centroids = [[int(np.floor(scale * x)) for x in r["v"]] for r in first] or [[0] * dim]
    trees = cut(kept.mapInArrow(_trees(dim, scale), _TREE), "trees", **{"parquet.block.size": str(32 << 20)})
    for _ in range(rounds):
        sums = trees.mapInArrow(_summed(centroids), "cluster int, n long, sums array<decimal(38,0)>")
        for r in sums.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("sums", F.lit(i))) for i in range(dim))).alias("sums")).collect():  # a row for each centroid
            centroids[r["cluster"]] = [int(x) // r["n"] for x in r["sums"]]
    out = cut(trees.mapInArrow(_assigned(centroids), "vec_id long, cluster int, distance long"), "assigned")
    drop(trees)
    inertia = {r["cluster"]: int(r["s"]) if r["whole"] else None for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.bool_and(F.col("distance").isNotNull()).alias("whole")).collect()}
    short = lambda x: x if x is not None and x < 1 << 63 else None
    total = None if None in inertia.values() else sum(inertia.values())
    told = [(j, short(inertia.get(j)), short(total), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids)]
    side = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(side), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
