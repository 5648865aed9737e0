"""Near-duplicate groups by a chosen-path set similarity join.

Texts become sets of word shingles. Equal sets are one class, known by 64 bits of its digest whatever ids its rows have, and only
its representative goes on. In each of TREES
independent trees a representative follows the path of its FIRST minwise tokens. Two sets of similarity s share a node of depth
d with probability s ** d, so that at s = 0.8 a pair is missed by all trees with probability (1 - 0.8 ** 3) ** 24 = 3e-8. No
node is branched further, large or not: deeper paths would share their functions with other trees and lose pairs.

Nodes are compared in two rounds. First each member proposes the partner of its node that looks most alike and the least
one (nodes of over LEAF are dealt into random parts for this); proposals are confirmed on full sets and give components. Then only nodes in which different components meet are
compared exhaustively, on full sets too, so that a group of many alike sets costs a number of pairs linear in its size.
Sketches of SKETCH bytes decide which pairs are worth it: a pair at the threshold passes but for a chance of 1e-6.

Of a large node in which one component is all but LEAF members, the few others are compared with all of it, part by part.
Other large nodes are split by size, so that sets whose sizes allow the threshold stay together, and then compared in pairs of
blocks of LEAF members: nothing is capped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm import tokens
from agora.llm.graph import components
from agora.llm.shared import bounded, cut, drop, look_up, release, small

TREES, FIRST, LEAF, SKETCH = 24, 3, 400, 96
#: Sketches of two sets at the threshold agree in at least this share of threshold * SKETCH bytes.
SLACK = 0.745
_rng = np.random.Generator(np.random.PCG64(7))
FLIP, TURN = _rng.integers(0, 1 << 32, SKETCH, dtype=np.uint32), _rng.integers(0, 1 << 31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
#: The minwise functions along each tree's path; no two trees share one.
MEMBER = ["node", "tree", "id", "n", "part", "trees", "sketch"]
PATHS = np.stack([np.roll(np.arange(SKETCH), -FIRST * t) for t in range(TREES)])[:, :FIRST]


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _key(digest: bytes | None) -> int | None:
    """The class of a set, as a long."""
    return None if digest is None else int.from_bytes(digest[:8], "little", signed=True)


def features(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch):
                sets = list(tokens.shingle_sets(part.column("text"), shingle))
                sizes = np.array([len(s) for s in sets])
                low = np.zeros((len(sets), SKETCH), np.uint32)
                if some := np.flatnonzero(sizes).tolist():
                    x = (np.concatenate(sets) >> tokens.U(32)).astype(np.uint32)
                    at = np.concatenate([[0], np.cumsum(sizes[some])[:-1]])
                    for k in range(SKETCH):
                        low[some, k] = np.minimum.reduceat((x ^ FLIP[k]) * TURN[k], at)
                keys = tree_keys(low)
                h = [_digest(s) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(h, pa.binary()), pa.array(list(map(_key, h)), pa.int64()), pa.array([r.tobytes() for r in keys], pa.binary()), pa.array([r.tobytes() for r in low.astype(np.uint8)], pa.binary())],
                    names=["doc_id", "n", "h", "id", "trees", "sketch"],
                )

    return run


def full_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tokens.slices(batch):
                sets = [s for s in tokens.shingle_sets(part.column("text"), shingle) if len(s)]
                yield pa.RecordBatch.from_arrays([pa.array([_key(_digest(s)) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.large_binary()).cast(pa.binary())], names=["id", "set"])

    return run


def _matrix(col: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(-1, width)


def tree_keys(low: np.ndarray) -> np.ndarray:
    """The node that each row of minwise values reaches in each tree."""
    key = np.tile(np.arange(1, TREES + 1, dtype=np.uint64), (len(low), 1))
    for k in range(PATHS.shape[1]):
        key = tokens.mix(key * tokens.U(0xD1342543DE82EF95) + low[:, PATHS[:, k]])
    return key


def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, tree, id): each id in its node of every tree."""
    for batch in batches:
        keys = _matrix(batch.column("trees"), np.uint64, TREES)
        for tree in range(TREES):
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, tree].astype(np.int64)), pa.array(np.full(len(keys), tree, np.int8)), batch.column("id")], names=["node", "tree", "id"])


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """The rows of each key, from batches that are sorted by it; runs are joined across batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        if rest and rest[-1].column(key)[0].as_py() != k[0]:
            yield pa.concat_batches(rest) if len(rest) > 1 else rest[0]
            rest = []
        for a, b in zip(at[:-1], at[1:], strict=True):
            rest.append(batch.slice(a, b - a))
            if b < len(k):
                yield pa.concat_batches(rest) if len(rest) > 1 else rest[0]
                rest = []
    if rest:
        yield pa.concat_batches(rest) if len(rest) > 1 else rest[0]


def _sorted(df: DataFrame, key: str) -> DataFrame:
    return df.repartition(key).sortWithinPartitions(key)


def alike(sketch: np.ndarray, n: np.ndarray, i: int, threshold: float) -> np.ndarray:
    """Bytes in which each sketch agrees with the i-th; 0 for those whose size or sketch rules the threshold out."""
    same = (sketch == sketch[i]).sum(1)
    low, high = np.minimum(n, n[i]), np.maximum(n, n[i])
    return np.where((low >= threshold * high) & (same >= SLACK * threshold * SKETCH), same, 0)


def proposals(threshold: float):
    """Per node: each member with the member that looks most alike, and with the least one that looks alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = [], []
        for g in groups(batches, "node"):
            ids, n, sk = g.column("id").to_numpy(), g.column("n").to_numpy(), _matrix(g.column("sketch"), np.uint8, SKETCH)
            order = np.argsort(ids)
            ids, n, sk = ids[order], n[order], sk[order]
            for i in range(len(ids)):
                same = alike(sk, n, i, threshold)
                same[i] = 0
                if not same.any():
                    continue
                hit = np.unique([int(same.argmax()), int((same > 0).argmax())])
                left += np.minimum(ids[hit], ids[i]).tolist()
                right += np.maximum(ids[hit], ids[i]).tolist()
            if len(left) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
                left, right = [], []
        yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def _new(trees: np.ndarray, tree: int, i: int, others: np.ndarray) -> np.ndarray:
    """Those of others that share no node with i in a tree before this one: no pair is compared twice."""
    return others[(trees[others, :tree] != trees[i, :tree]).all(1)]


def strangers(threshold: float):
    """Per node: the members that look like a member of another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "node"):
            part, n, sk, tree = g.column("part").to_numpy(), g.column("n").to_numpy(), _matrix(g.column("sketch"), np.uint8, SKETCH), g.column("tree")[0].as_py()
            trees, hit = _matrix(g.column("trees"), np.uint64, TREES), np.zeros(len(part), bool)
            for i in _minor(part):
                other = _new(trees, tree, i, np.flatnonzero((alike(sk, n, i, threshold) > 0) & (part != part[i])))
                hit[other] = True
                hit[i] |= len(other) > 0
            if hit.any():
                yield g.filter(pa.array(hit)).select(MEMBER)

    return run


def _minor(part: np.ndarray) -> np.ndarray:
    """The members outside the node's main component: every pair of different components has one."""
    _, of, count = np.unique(part, return_inverse=True, return_counts=True)
    return np.flatnonzero(of != count.argmax())


def _reach(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """|x & y| >= threshold * |x | y|, decided in whole numbers."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    both = int((y[at] == x).sum()) if len(y) else 0
    return 100 * both >= round(100 * threshold) * (len(x) + len(y) - both)


def exhaustive(threshold: float):
    """Per node: pairs of components with a link that full sets confirm, as many as connect them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in groups(batches, "node"):
            part, n, sk, tree = g.column("part").to_numpy(), g.column("n").to_numpy(), _matrix(g.column("sketch"), np.uint8, SKETCH), g.column("tree")[0].as_py()
            trees, sets = _matrix(g.column("trees"), np.uint64, TREES), [np.frombuffer(b.as_buffer(), np.uint64) for b in g.column("set")]
            left, right, now = [], [], part.copy()
            for i in _minor(part):
                for j in _new(trees, tree, i, np.flatnonzero((alike(sk, n, i, threshold) > 0) & (part != part[i]))):
                    if now[i] != now[j] and _reach(sets[i], sets[j], threshold):
                        left.append(part[i])
                        right.append(part[j])
                        now[now == now[j]] = now[i]
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def confirm(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            yes = [_reach(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), threshold) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(yes, pa.bool_()))

    return run


def _sets_of(docs: DataFrame, classes: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """Full sets of the classes in ids (id); texts of their first documents are read again rather than kept as sets."""
    wanted = small(ids)
    some = docs.join(small(classes.join(wanted, "id", "left_semi").select("doc_id").distinct()), "doc_id", "left_semi")
    return some.mapInArrow(full_sets(shingle), "id long, set binary").join(wanted, "id", "left_semi").dropDuplicates(["id"])


def _by_size(rows: DataFrame, threshold: float) -> DataFrame:
    """Nodes as overlapping ranges of size (n), each a node of its own: any two sizes at the threshold or closer share a range."""
    band = F.floor(F.log("n") / F.lit(-1.0001 * math.log(threshold)))
    return rows.withColumn("band", F.explode(F.array(band, band + 1))).withColumn("node", F.xxhash64("node", "band")).drop("band")


def _in_blocks(rows: DataFrame) -> DataFrame:
    """Nodes of over LEAF members as pairs of blocks, each a node of its own."""
    blocks = rows.join(rows.groupBy("node").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("k")), "node")
    mine = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    return (
        blocks.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        .withColumn("node", F.xxhash64("node", F.least("mine", "other"), F.greatest("mine", "other"))).drop("k", "mine", "other")
    )


def _dealt(rows: DataFrame) -> DataFrame:
    """Large nodes of one main component: its members are dealt into parts of about LEAF, and the few others go to each part."""
    k = F.ceil(F.col("c") / LEAF).cast("int")
    here = F.when(F.col("part") == F.col("major"), F.array(F.pmod(F.xxhash64("id", "node"), k).cast("int"))).otherwise(F.sequence(F.lit(0), k - 1))
    return rows.select(F.explode(here).alias("at"), "node", "tree", "id", "part").select(F.xxhash64("node", "at").alias("node"), "tree", "id", "part")


def cluster(docs: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text; other columns are not read).

    Words are lower-cased (A-Z). Null or empty texts and texts of blanks have no shingles and link with nothing. Rows with a
    null doc_id are left out of the search: they come back with a null component and are kept. Repeated rows come back as
    often as they came; of rows that share a doc_id with different texts each keeps its own links. An empty table gives no rows.
    """
    bounded(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    feats = cut(docs.mapInArrow(features(shingle), "doc_id long, n long, h binary, id long, trees binary, sketch binary").withColumn("row", F.monotonically_increasing_id()), "features")
    # Equal sets: the first row of the least doc_id stands for all. Null ids and empty sets are in no class.
    classes = feats.where("doc_id is not null and h is not null").groupBy("h").agg(F.first("id").alias("id"), F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("c"))
    classes = cut(classes.select("h", "id", "first.doc_id", "first.row", "c"), "classes")
    known = feats.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("h")).alias("h"))
    members = cut(look_up(known, classes.select("h", "id", "c"), ["h"], "c", "left").select("doc_id", "n", "id"), "members")
    only = small(classes.select("row"), classes.count())
    info = cut(feats.join(only, "row").select("id", "n", "trees", "sketch"), "representatives")
    drop(feats)

    # The trees: nodes that hold two or more.
    at = cut(_alive(info.select("id", "trees").mapInArrow(nodes, "node long, tree byte, id long")), "nodes")
    leaves, large = at.where(f"c <= {LEAF}"), at.where(f"c > {LEAF}")
    # Large nodes are dealt at random into parts of about LEAF: proposals of 24 trees connect what is alike throughout.
    parts_of = F.ceil(F.col("c") / LEAF)
    dealt = F.when(F.col("c") > LEAF, F.xxhash64("node", F.pmod(F.xxhash64("id", "node"), parts_of))).otherwise(F.col("node"))
    first = at.select(dealt.alias("node"), "id").join(info.select("id", "n", "sketch"), "id")
    pairs = cut(_sorted(first, "node").mapInArrow(proposals(threshold), "a long, b long").distinct(), "proposals")
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = cut(_sets_of(docs, classes, ids, shingle), "sets")
    paired = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    links = cut(paired.mapInArrow(confirm(threshold), "a long, b long"), "links")
    drop(sets)
    drop(pairs)
    release(docs.sparkSession)
    parts = components(links)

    # What different components still share a node: large nodes in parts, then every pair.
    part = cut(info.select("id").distinct().join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("part")), "parts")
    drop(links)
    kept = [_mixed(leaves.select("node", "tree", "id").join(part, "id"))]
    large = cut(_mixed(large.select("node", "tree", "id").join(part, "id")), "large")
    held = [at, large]
    if not large.isEmpty():
        per = large.groupBy("node", "part").agg(F.count("*").alias("c"))
        whole = per.groupBy("node").agg(F.max_by("part", F.struct("c", "part")).alias("major"), F.max("c").alias("most"), F.sum("c").alias("c"))
        told = cut(large.join(whole, "node"), "large")
        kept.append(_dealt(told.where(f"c - most <= {LEAF}")))
        many = told.where(f"c - most > {LEAF}").select("node", "tree", "id", "part")
        held.append(told)
        if not many.isEmpty():
            ranges = cut(_mixed(_by_size(many.join(info.select("id", "n"), "id"), threshold).select("node", "tree", "id", "part")), "ranges")
            kept.append(_mixed(_in_blocks(ranges)))
            held.append(ranges)
    meet = kept[0].select("node", "tree", "id", "part")
    for k in kept[1:]:
        meet = meet.union(k.select("node", "tree", "id", "part"))
    shape = "node long, tree byte, id long, n long, part long, trees binary, sketch binary"
    odd = cut(_sorted(meet.join(info, "id"), "node").mapInArrow(strangers(threshold), shape), "strangers")
    more = cut(_sets_of(docs, classes, odd.select("id").distinct(), shingle), "sets")
    extra = cut(_sorted(odd.join(more, "id"), "node").mapInArrow(exhaustive(threshold), "a long, b long"), "links")
    if not extra.isEmpty():  # components that belong together
        joined = components(extra).withColumnsRenamed({"id": "part", "component": "whole"})
        part = part.join(small(joined), "part", "left").select("id", F.coalesce("whole", "part").alias("part"))
    # Each component's least doc_id, for its classes and then for their rows.
    joined = cut(part.dropDuplicates(["id"]).join(classes.select("id", "doc_id", "c"), "id"), "joined")
    least = cut(joined.groupBy("part").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("k")), "least")
    found = cut(look_up(joined, least, ["part"], "k").select("id", "component_id", "c"), "found")
    for table in (more, odd, extra, info, classes, joined, least, *held):
        drop(table)
    release(docs.sparkSession)
    out = look_up(members, found, ["id"], "c", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _alive(rows: DataFrame) -> DataFrame:
    """rows with c, the members of their node; nodes of one member go. Counts are combined before the shuffle."""
    return rows.join(rows.groupBy("node").agg(F.count("*").alias("c")).where("c > 1"), "node")


def _mixed(rows: DataFrame) -> DataFrame:
    """The rows of nodes in which different components meet."""
    return rows.join(rows.groupBy("node").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("node"), "node", "left_semi")
