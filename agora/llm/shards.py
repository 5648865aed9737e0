"""Shards by a k-d tree over metadata, with equal bytes in every leaf.

A node with k leaves to make is split along the dimension in which it is widest, at the weighted quantile that gives the left
child its share of bytes. Quantiles are found by histograms: each round adds up bytes per bin for all open nodes on the
executors and brings at most BINS sums for each of them to the driver, however many rows there are. A row's node is an
expression of its keys, with the splits so far as literals: no round joins anything, and only metadata is read.

Rows of equal texts share the place of the first of them and so a shard, unless together they have over WHOLE of a shard's
bytes: then they are dealt out like any other rows, as shards could not be near equal otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from agora.llm.shared import cut, drop, look_up

BINS = 8192
#: Share of a leaf's bytes within which a split is exact enough; smaller than any one row, it means as exact as rows allow.
CLOSE = 0.0005
#: Share of a shard's bytes up to which equal texts are held together.
WHOLE = 1 / 16
#: Rows of a shard that are numbered in one task.
BLOCK = 50_000


def _coordinate(df: DataFrame, name: str) -> Column:
    """Numbers as they are, text by its hash; null counts as 0."""
    kind = dict(df.dtypes)[name]
    if kind in ("string", "binary"):
        return F.coalesce(F.crc32(F.col(name)), F.lit(0)).cast("double")
    return F.coalesce(F.col(name).cast("double"), F.lit(0.0))


def assign(docs: DataFrame, shards: int, dims: tuple[str, ...] = ("n_chars", "doc_id", "source", "lang")) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of docs; law is "bytes".

    size is the text's UTF-8 bytes plus 8; a null text has none. Rows equal in a dimension are parted by a hash, so that one
    value or source that fills a third of the table is divided as evenly as any. Equal texts go to one shard if they have WHOLE
    of a shard's bytes or less, null and empty ones too. Null metadata counts as 0; dimensions
    that docs lacks are left out. An empty table gives no rows; fewer rows than shards leave shards empty.
    """
    dims = tuple(d for d in dims if d in docs.columns) or ("doc_id",)
    rows, n = _keyed(docs, shards, dims)
    tree: dict[int, tuple[int, int, int, int]] = {}  # by inner node: dimension, key from which rows go right, the two children
    leaves, first, fresh = {0: shards}, {0: 0}, 1  # by node: leaves to make, number of the first of them
    while open_nodes := [x for x, k in leaves.items() if k > 1]:
        splits = _medians(rows, tree, {x: leaves[x] for x in open_nodes}, len(dims))
        for x in open_nodes:
            k = leaves.pop(x)
            left, right, half = fresh, fresh + 1, k // 2
            fresh += 2
            leaves |= {left: half, right: k - half}
            first |= {left: first[x], right: first[x] + half}
            tree[x] = (*splits.get(x, (0, 0)), left, right)
    shard = _place(tree, lambda x: F.lit(first[x]))
    return _numbered(rows.select("doc_id", "size", "text_crc32", "row", shard.alias("shard")), max(1, n // (shards * BLOCK)))


def _keyed(docs: DataFrame, shards: int, dims: tuple[str, ...]) -> tuple[DataFrame, int]:
    """(doc_id, size, text_crc32, row, k) with a whole number for each dimension in k, and the number of rows."""
    text = F.col("text").cast("string")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.xxhash64(F.coalesce(text, F.lit(""))).alias("same"), F.array(*(_coordinate(docs, d) for d in dims)).alias("c"), F.monotonically_increasing_id().alias("row"),
    )
    base = cut(base, "metadata")
    edges = [f(F.col("c")[k]).alias(f"{name}{k}") for k in range(len(dims)) for name, f in (("lo", F.min), ("hi", F.max))]
    ends = base.agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), *edges).first()
    equal = ["same", "text_crc32", "size"]
    groups = base.groupBy(*equal).agg(F.min(F.struct("doc_id", "row", "c")).alias("first"), F.count("*").alias("times"))
    groups = cut(groups.where((F.col("times") > 1) & (F.col("times") * F.col("size") <= WHOLE * (ends["bytes"] or 0) / shards)), "groups")
    joined = look_up(base, groups, equal, "times", "left")
    alone = F.col("first").isNull()
    # A key has the coordinate in its upper 31 bits, then a hash of the row's values, then a few bits that part repeated rows.
    tie = F.when(alone, F.shiftrightunsigned(F.xxhash64("text_crc32", "doc_id"), 40) * 256 + F.pmod(F.col("row"), F.lit(256))).otherwise(F.shiftrightunsigned(F.xxhash64("same", "text_crc32"), 40) * 256)
    c = F.when(alone, F.col("c")).otherwise(F.col("first.c"))

    def key(k: int) -> Column:
        low, high = ends[f"lo{k}"] or 0, ends[f"hi{k}"] or 0
        return F.floor((c[k] - F.lit(low)) / F.lit(max(high - low, 1e-9)) * F.lit(float((1 << 31) - 1))).cast("long") * F.lit(1 << 32) + tie

    rows = cut(joined.select("doc_id", "size", "text_crc32", "row", F.array(*(key(k) for k in range(len(dims)))).alias("k")), "keys")
    drop(base)
    drop(groups)
    return rows, ends["n"] or 0


def _place(tree: dict[int, tuple[int, int, int, int]], leaf, x: int = 0) -> Column:
    """What leaf gives for the node that a row is in."""
    if x not in tree:
        return leaf(x)
    dim, at, left, right = tree[x]
    return F.when(F.col("k")[dim] < F.lit(at), _place(tree, leaf, left)).otherwise(_place(tree, leaf, right))


def _medians(rows: DataFrame, tree: dict, leaves: dict[int, int], dims: int) -> dict[int, tuple[int, int]]:
    """For each open node (with its leaves to make) the widest dimension and the key from which its rows go right."""
    node = _place(tree, lambda x: F.lit(x))
    edges = [f(F.col("k")[k]).alias(f"{name}{k}") for k in range(dims) for name, f in (("lo", F.min), ("hi", F.max))]
    found = rows.groupBy(node.alias("node")).agg(F.sum("size").alias("size"), *edges).collect()  # a row for each node
    state = {}
    for r in found:
        if (x := r["node"]) in leaves:
            dim = max(range(dims), key=lambda k: (r[f"hi{k}"] - r[f"lo{k}"], -k))
            state[x] = {"dim": dim, "lo": r[f"lo{dim}"], "hi": r[f"hi{dim}"] + 1, "below": 0, "want": r["size"] * (leaves[x] // 2) / leaves[x], "close": CLOSE * r["size"] / leaves[x], "done": False}
    none = F.lit(None).cast("struct<node:int,bin:int>")
    while busy := {x: s for x, s in state.items() if not s["done"]}:
        steps = {x: max(1, -(-(s["hi"] - s["lo"]) // BINS)) for x, s in busy.items()}

        def bin_of(x: int) -> Column:
            if x not in busy:
                return none
            s, at = busy[x], F.col("k")[busy[x]["dim"]]
            place = F.expr(f"cast((k[{s['dim']}] - {s['lo']}L) div {steps[x]}L as int)")
            return F.when((at >= F.lit(s["lo"])) & (at < F.lit(s["hi"])), F.struct(F.lit(x).alias("node"), place.alias("bin"))).otherwise(none)

        bins = rows.select(_place(tree, bin_of).alias("at"), "size").where("at is not null").groupBy("at.node", "at.bin").agg(F.sum("size").alias("w"))
        sums: dict[int, dict[int, int]] = {}
        for r in bins.collect():  # at most BINS rows for each node
            sums.setdefault(r["node"], {})[r["bin"]] = r["w"]
        for x, s in busy.items():
            got, lo, hi, step = sums.get(x, {}), s["lo"], s["hi"], steps[x]
            for b in sorted(got):
                if s["below"] + got[b] >= s["want"]:
                    s["lo"], s["hi"] = lo + b * step, min(hi, lo + (b + 1) * step)
                    if got[b] <= s["close"] or s["hi"] - s["lo"] <= 1:
                        nearer = s["want"] - s["below"] > s["below"] + got[b] - s["want"]
                        s["lo"], s["done"] = s["hi"] if nearer else s["lo"], True
                    break
                s["below"] += got[b]
            else:
                s["lo"], s["done"] = hi, True
    return {x: (s["dim"], s["lo"]) for x, s in state.items()}


def _numbered(rows: DataFrame, blocks: int) -> DataFrame:
    """Slots without gaps in each shard: blocks are counted, then numbered each by itself from its offset."""
    from pyspark.sql import Window

    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "row"), F.lit(blocks)).cast("int"))
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("c"))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "row")
    slot = F.row_number().over(within) - 1 + F.col("offset")
    return rows.join(offsets, ["shard", "block"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
