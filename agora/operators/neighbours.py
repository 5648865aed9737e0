"""Exact nearest neighbours of all vectors by a metric partition.

Unit vectors at cosine distance d are sqrt(2d) apart, which is a metric. Vectors fall into cells around pivots; a cell knows the least
and the greatest distance of its vectors from the pivot. In a first round each vector is compared with its own cell, which bounds the
distance of its k-th neighbour. In the second it is compared only with the cells that the triangle inequality does not rule out by that
bound, which shrinks as nearer ones are found. Cells of over BLOCK vectors are dealt out in parts. Parts lie on shelves, and a vector
is sent once to each shelf with an open cell, not to each cell; the visitors of a shelf come in chunks, so that a task holds about SHELF
of either. Shelves are SHELVES up to SHELVES * SHELF vectors: what is shuffled then grows with the vectors, beyond it with their
product with the number of shelves.
Equal vectors are compared once; each hands on its k + 1 least ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.operators.folders import scratch, written
from agora.operators.order import top_per_group

#: Vectors of a cell on average; pivots at most, which the driver and every task hold; vectors of one side in a task.
CELL, PIVOTS, BLOCK = 2048, 1024, 8192
#: Vectors of a shelf, and shelves at least, where there are so many parts of cells.
SHELF, SHELVES = 65_536, 6
#: Distances are rounded to 6 digits, and ties go by id: a cell is ruled out only beyond this.
SLACK = 2e-6
#: Rows of at most 64 bytes that a join may broadcast.
BROADCAST_ROWS = 500_000
_FOUND = "src long, dst long, distance double"


def check_dimension(vectors: DataFrame, vector: str) -> int:
    """The common length of all vectors; more than one raises. An empty table has length 0."""
    lo, hi = vectors.where(F.col(vector).isNotNull()).agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if lo != hi:
        raise ValueError(f"vectors of {lo} and of {hi} numbers can't be compared")
    return lo or 0


def matrix(col: pa.Array) -> np.ndarray:
    """An Arrow column of lists of one length, as rows."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(col), -1 if len(col) else 0)


def _packed(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), float).reshape(len(col), dim)


def _apart(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * u @ pivots.T))


def _placed(pivots: np.ndarray | None):
    """Vectors scaled to length 1 (zeros stay, and are at distance 1 from all), each with its nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = matrix(batch.column("v"))
            u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
            cell, r = np.zeros(len(u), np.int32), np.zeros(len(u))
            if pivots is not None:
                far = _apart(u, pivots)
                cell, r = far.argmin(1).astype(np.int32), far.min(1)
            yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.array([x.tobytes() for x in u], pa.binary()), pa.array(cell), pa.array(r)], names=["rep", "u", "cell", "r"])

    return run


def _best(u: np.ndarray, ids: np.ndarray, v: np.ndarray, dst: np.ndarray, k: int, most: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in u, id, distance) of the k nearest of v, ties by id, for each row of u; itself and those beyond most are left out."""
    order = np.argsort(dst, kind="stable")
    dst, v = dst[order], v[order]
    out = []
    for a in range(0, len(u), 512):
        d = np.round(1.0 - u[a : a + 512] @ v.T, 6)
        d[ids[a : a + 512, None] == dst[None]] = np.inf
        if most is not None:
            d[d > most[a : a + 512, None]] = np.inf
        n = min(k, d.shape[1])
        if d.shape[1] > 4 * k:  # all rows that can be among the k first, ties included, before they are sorted
            edge = np.partition(d, n - 1, axis=1)[:, n - 1]
            row, col = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
        else:
            row, col = np.nonzero(np.isfinite(d))
        x = d[row, col]
        sort = np.lexsort((col, x, row))
        row, col, x = row[sort], col[sort], x[sort]
        first = np.searchsorted(row, np.arange(len(d)))
        ok = np.arange(len(row)) - first[row] < k
        out.append((row[ok] + a, dst[col[ok]], x[ok]))
    return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))


def _open(u: np.ndarray, cell: int, own: np.ndarray, most: np.ndarray, pivots: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of the vectors can have one of this cell within most: by the cell's ring around its pivot, and as each vector of it is
    nearer to that pivot than to the visitor's own, at distance own."""
    far = _apart(u, pivots[[cell]])[:, 0]
    return np.maximum(np.maximum(far - high[cell], low[cell] - far), (far - own) / 2) <= np.sqrt(2 * (most + SLACK)) + 1e-7


def _first(k: int, dim: int, pivots: np.ndarray | None, low: np.ndarray, high: np.ndarray, units: np.ndarray, shelf: np.ndarray, seen: Accumulator | None):
    """Neighbours in the own part of the own cell, and the shelves where nearer ones can be."""

    def run(t: pa.Table) -> pa.Table:
        ids, u = t.column("rep").to_numpy(), _packed(t.column("u").combine_chunks(), dim)
        if seen is not None:
            seen.add(len(ids) ** 2)
        row, dst, d = _best(u, ids, u, ids, k)
        at = np.searchsorted(row, np.arange(len(ids) + 1))
        full = np.diff(at) == k
        bound = np.where(full, d[np.maximum(at[1:] - 1, 0)] if len(d) else 0.0, np.inf)
        visits = np.zeros((len(ids), shelf.max(initial=0) + 1), bool)
        if units[-1] > 1:
            own, here = t.column("r").to_numpy(), int(t.column("unit")[0].as_py())
            for c in range(len(units) - 1):
                on = {int(shelf[x]) for x in range(units[c], units[c + 1]) if x != here}
                if on:
                    visits[np.ix_(_open(u, c, own, bound, pivots, low, high), sorted(on))] = True
        near = [[{"dst": int(i), "distance": float(x)} for i, x in zip(dst[a:b], d[a:b], strict=True)] for a, b in zip(at[:-1], at[1:], strict=True)]
        kind = pa.list_(pa.struct([("dst", pa.int64()), ("distance", pa.float64())]))
        return pa.table({"src": ids, "u": t.column("u"), "cell": t.column("cell"), "r": t.column("r"), "unit": t.column("unit"), "most": bound, "near": pa.array(near, kind), "visits": pa.array([np.flatnonzero(v).tolist() for v in visits], pa.list_(pa.int32()))})

    return run


def _second(k: int, dim: int, pivots: np.ndarray | None, low: np.ndarray, high: np.ndarray, seen: Accumulator | None):
    """The k nearest on a shelf for each of its visitors, within their bounds; a visitor's own part was compared before."""

    def run(t: pa.Table) -> pa.Table:
        visitor = t.column("visitor").to_numpy()
        ids, unit, cell = (t.column(c).to_numpy() for c in ("src", "unit", "cell"))
        u, most, own = _packed(t.column("u").combine_chunks(), dim), t.column("most").to_numpy()[visitor], t.column("r").to_numpy()[visitor]
        src, here, guests = ids[visitor], unit[visitor], u[visitor]
        best, far = np.full((len(src), k), np.iinfo(np.int64).max), np.full((len(src), k), np.inf)
        most = most.copy()
        for x in np.unique(unit[~visitor]):
            held = np.flatnonzero(~visitor & (unit == x))
            some = np.flatnonzero(_open(guests, int(cell[held[0]]), own, most, pivots, low, high) & (here != x))
            if not len(some):
                continue
            if seen is not None:
                seen.add(len(some) * len(held))
            row, dst, d = _best(guests[some], src[some], u[held], ids[held], k, most[some])
            place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(some)))[row]
            more, at = np.full((len(some), k), np.iinfo(np.int64).max), np.full((len(some), k), np.inf)
            more[row, place], at[row, place] = dst, d
            more, at = np.hstack([best[some], more]), np.hstack([far[some], at])
            order = np.lexsort((more, at), axis=1)[:, :k]
            best[some], far[some] = np.take_along_axis(more, order, 1), np.take_along_axis(at, order, 1)
            most[some] = np.minimum(most[some], far[some][:, -1])
        row, col = np.nonzero(np.isfinite(far))
        return pa.table({"src": src[row], "dst": best[row, col], "distance": far[row, col]})

    return run


def neighbours(vectors: DataFrame, k: int, id: str = "vec_id", vector: str = "embedding", compared: Accumulator | None = None) -> DataFrame:
    """(src, dst, rank, distance): for each vector its k nearest others by cosine distance, ties by id, itself never among them.

    Null vectors and those with null, NaN or infinite numbers are left out, zero vectors are at distance 1; rows that share an id
    and a vector count once. compared, an accumulator, gets the number of pairs that tasks compare."""
    v = F.col("v")
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    dim = check_dimension(rows, "v")
    path = scratch(vectors.sparkSession, "neighbours")
    place = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    groups = rows.withColumn("p", place).where(F.col("p") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids"))  # k + 1 ids at most
    reps = written(groups.select(F.col("ids")[0].alias("rep"), "ids", "v"), f"{path}/vectors")
    n, copies = reps.agg(F.count("*"), F.coalesce(F.sum((F.size("ids") > 1).cast("long")), F.lit(0))).first()
    near = _near(reps, n, k, dim, path, compared)
    if copies:
        near = _copied(rows, reps, near, k)
    return near.select("src", "dst", "rank", "distance")


def _near(reps: DataFrame, n: int, k: int, dim: int, path: str, seen: Accumulator | None) -> DataFrame:
    """neighbours() of distinct vectors (rep, v)."""
    pivots = None
    if n > CELL:
        drawn = reps.orderBy(F.xxhash64("rep"), "rep").limit(min(PIVOTS, -(-n // CELL))).collect()  # bounded
        pivots = np.array([r["v"] for r in drawn], float)
        pivots /= np.maximum(np.linalg.norm(pivots, axis=1, keepdims=True), 1e-12)
    placed = written(reps.select("rep", "v").mapInArrow(_placed(pivots), "rep long, u binary, cell int, r double"), f"{path}/cells")
    cells = 1 if pivots is None else len(pivots)
    low, high, parts, counts = np.full(cells, np.inf), np.full(cells, -np.inf), np.zeros(cells, np.int64), np.zeros(cells, np.int64)
    for r in placed.groupBy("cell").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n")).collect():  # a row for each pivot
        low[r["cell"]], high[r["cell"]], parts[r["cell"]], counts[r["cell"]] = r["low"], r["high"], -(-r["n"] // BLOCK), r["n"]
    units = np.concatenate([[0], np.cumsum(parts)])
    # Shelves of about equal numbers of vectors, each of parts that follow each other.
    held = np.repeat(counts / np.maximum(parts, 1), parts)
    shelves = min(int(units[-1]), max(SHELVES, -(-n // SHELF)))
    shelf = ((np.cumsum(held) - held / 2) * shelves / max(n, 1)).astype(int)
    at, many = F.array(*(F.lit(int(x)) for x in units)), F.array(*(F.lit(int(max(1, x))) for x in parts))
    placed = placed.withColumn("unit", (F.get(at, F.col("cell")) + F.pmod(F.xxhash64("rep"), F.get(many, F.col("cell")))).cast("int"))
    first = placed.groupBy("unit").applyInArrow(_first(k, dim, pivots, low, high, units, shelf, seen), "src long, u binary, cell int, r double, unit int, most double, near array<struct<dst:long,distance:double>>, visits array<int>")
    if units[-1] > 1:
        first = written(first, f"{path}/first")
    found = first.select("src", F.explode("near").alias("x")).select("src", "x.dst", "x.distance")
    if units[-1] > 1:
        # Chunks of visitors as large as a shelf, for each shelf that has any.
        told = first.select(F.explode("visits").alias("shelf")).groupBy("shelf").agg(F.count("*").alias("n")).collect()  # a row for each shelf
        chunks = {r["shelf"]: -(-r["n"] * shelves // n) for r in told}
        if chunks:
            each = F.create_map(*(F.lit(x) for s in sorted(chunks.items()) for x in s))
            row = ("src", "u", "unit", "cell", "r", "most")
            visitors = first.select(F.explode("visits").alias("shelf"), *row, F.lit(True).alias("visitor"))
            visitors = visitors.withColumn("chunk", F.pmod(F.xxhash64("src"), F.element_at(each, F.col("shelf"))).cast("int"))
            on = F.get(F.array(*(F.lit(int(x)) for x in shelf)), F.col("unit"))
            host = first.select(on.alias("shelf"), *row, F.lit(False).alias("visitor")).where(F.col("shelf").isin(sorted(chunks)))
            host = host.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.element_at(each, F.col("shelf")) - 1)))
            pairs = visitors.unionByName(host).repartition(sum(chunks.values()), "shelf", "chunk")
            found = found.unionByName(pairs.groupBy("shelf", "chunk").applyInArrow(_second(k, dim, pivots, low, high, seen), _FOUND))
    return top_per_group(found.withColumn("distance", F.round("distance", 6)), ["src"], [F.col("distance"), F.col("dst")], k)


def _copied(rows: DataFrame, reps: DataFrame, near: DataFrame, k: int) -> DataFrame:
    """Neighbours of all rows from those of distinct vectors: a neighbour stands for the ids of its group, and each group's own ids
    are at distance 0 (of zero vectors 1). A group's k + 1 best are one array, so that its members only look it up."""
    own = F.when(F.exists("v", lambda x: x != 0), 0.0).otherwise(1.0)
    far = near.select(F.col("src").alias("rep"), F.col("dst").alias("other"), "distance").join(reps.select(F.col("rep").alias("other"), "ids"), "other").select("rep", "distance", F.explode("ids").alias("dst"))
    mine = reps.select("rep", own.alias("distance"), F.explode("ids").alias("dst"))
    best = top_per_group(far.unionByName(mine), ["rep"], [F.col("distance"), F.col("dst")], k + 1)
    best = best.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("distance", "dst"))).alias("best"))  # k + 1 at most
    groups = reps.where(F.size("ids") > 1).select("rep", "v")
    single = reps.where(F.size("ids") == 1).select(F.col("rep").alias("src"), "rep").join(best, "rep")
    # Members of groups: groups are few against rows, and a large one is broadcast.
    told = groups.join(best, "rep").select("v", "best")
    told = F.broadcast(told) if groups.count() * max(1, k) <= BROADCAST_ROWS // 8 else told
    several = rows.distinct().join(told, "v").select(F.col("id").alias("src"), "best")
    every = single.select("src", "best").unionByName(several)
    kept = every.select("src", F.slice(F.filter("best", lambda x: x["dst"] != F.col("src")), 1, k).alias("best"))
    out = kept.select("src", F.posexplode("best").alias("p", "x")).select("src", "x.dst", (F.col("p") + 1).cast("long").alias("rank"), "x.distance")
    # Rows of one id with differing vectors are one source.
    return top_per_group(out.drop("rank").distinct(), ["src"], [F.col("distance"), F.col("dst")], k)
