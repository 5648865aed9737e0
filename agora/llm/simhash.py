"""Near duplicates by SimHash fingerprints, linked exactly through vantage-point trees.

Documents with one fingerprint become one vertex. Two fingerprints that differ in at most MOST bits differ in at most one bit (or none)
of one of a few blocks of bits, so there is one tree for each block. A level of a tree has a band of the block's bits, a vantage point
and a radius: a fingerprint is inside if its Hamming distance to the vantage point, over the band, is at most the radius. Bands do not
overlap, so the triangle bounds of the levels add up: a neighbour across the boundary of a level must differ in that band. Each
fingerprint lives in one shard, the cell of its sides, and is also a query in the shards across each boundary it touches; all other
branches are pruned. Inside a shard, bits are counted for all pairs and the links become a forest, so that no group yields all its pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from agora.llm.graph import components
from agora.llm.shared import cut, drop, look_up
from agora.llm.tokens import column, slices

#: Fingerprints that a shard has on average; the trees get deeper until it holds.
SHARD = 2048
#: Rows of a shard that one task compares; larger shards are dealt out by pairs of blocks.
BLOCK = 16384
#: Fingerprints from which vantage points and radii are chosen; they weigh on balance, not on results.
SAMPLE = 4096
PIECE = 1 << 20

_GAP = re.compile(rb"[\x09-\x0d ]")


def _pieces(data: bytes) -> Iterator[bytes]:
    """data in pieces of about PIECE bytes that cut no word."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + PIECE)
        to = gap.end() if gap else len(data)
        yield data[at:to]
        at = to


def fingerprint(data: bytes, n: int = 4, seed: int = 42) -> int:
    """Bits set in over half the XXH64 of all runs of n words, A-Z lower-cased; of fewer words the whole sequence; of none 0."""
    ones, total, carry = np.zeros(64, np.int64), 0, []
    digest = xxhash.xxh64_intdigest
    for piece in _pieces(data):
        words = carry + piece.lower().split()
        if len(words) >= n:
            text = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate([[0], ends[:-1] + 1])
            h = np.array([digest(text[a:b], seed) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)], np.uint64)
            for i in range(0, len(h), 1 << 15):
                ones += np.unpackbits(h[i : i + (1 << 15)].view(np.uint8), bitorder="little").reshape(-1, 64).sum(0).astype(np.int64)
            total += len(h)
            words = words[len(words) - n + 1 :]
        carry = words
    if not total:
        return digest(b" ".join(carry), seed) if carry else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def _fingerprints(n: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                buf, at = column(part.column("text"))
                bits = np.array([fingerprint(buf[a:b].tobytes(), n, seed) for a, b in zip(at[:-1], at[1:], strict=True)], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(bits.view(np.int64))], names=["doc_id", "fp"])

    return run


def blocks(most: int) -> list[tuple[int, int, int]]:
    """(first bit, end, budget) of blocks of which at least one has no more differing bits than its budget, 1 or 0, if two
    fingerprints differ in most bits or fewer: were all over it, there would be most + 1."""
    budgets = [1] * ((most + 1) // 2) + [0] * ((most + 1) % 2)
    cuts = [64 * i // len(budgets) for i in range(len(budgets) + 1)]
    return list(zip(cuts[:-1], cuts[1:], budgets, strict=True))


def _levels(sample: np.ndarray, first: int, end: int, depth: int) -> list[tuple[int, int, int]]:
    """(mask, vantage point, radius) for each level: of a few sampled points and all radii the pair that halves the sample best."""
    out = []
    depth = min(depth, end - first)
    for level in range(depth):
        a, b = first + (end - first) * level // depth, first + (end - first) * (level + 1) // depth
        mask = np.uint64(((1 << (b - a)) - 1) << a)
        found = []
        for v in sample[:: max(1, len(sample) // 16)]:
            d = np.bitwise_count((sample ^ v) & mask)
            found += [(abs(int((d <= r).sum()) * 2 - len(sample)), int(v & mask), r) for r in range(b - a)]
        _, v, r = min(found)
        out.append((int(mask), v, r))
    return out


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def _shards(fp: Column, tree: int, levels: list[tuple[int, int, int]], budget: int) -> Column:
    """An array of (tree, shard, home): the shard where fp lives, and those across the boundaries that it touches from inside.

    Of a pair that a boundary parts, one is inside and at the radius: it alone goes across, so a pair meets once."""
    sides, across = [], []
    for i, (mask, v, r) in enumerate(levels):
        d = F.bit_count(fp.bitwiseAND(_signed(mask)).bitwiseXOR(_signed(v)))
        sides.append(F.when(d > r, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
        across.append(F.when(d == r, F.lit(1 << i).cast("long")))
    home = sum(sides[1:], sides[0])
    one = lambda shard, here: F.struct(F.lit(tree).alias("tree"), shard.alias("shard"), F.lit(here).alias("home"))
    if not budget:
        return F.array(one(home, True))
    flips = F.filter(F.array(*across), lambda x: x.isNotNull())
    return F.concat(F.array(one(home, True)), F.transform(flips, lambda x: one(home.bitwiseOR(x), False)))


def _near(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of a and which of b have a neighbour among the others. A fingerprint is no neighbour of itself."""
    x, y = np.zeros(len(a), bool), np.zeros(len(b), bool)
    step = max(1, (1 << 21) // max(1, len(b)))
    for i in range(0, len(a), step):
        d = a[i : i + step, None] ^ b[None]
        hit = (np.bitwise_count(d) <= most) & (d != 0)
        x[i : i + step] = hit.any(1)
        y |= hit.any(0)
    return x, y


def forest(points: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Links (root, member) that join what chains of neighbours join among points; each point is reached once and then left out."""
    rest = np.unique(points)
    while len(rest):
        root, front, rest = rest[0], rest[:1], rest[1:]
        while len(front) and len(rest):
            _, hit = _near(front, rest, most)
            front, rest = rest[hit], rest[~hit]
            for p in front:
                yield root, p


def _compared(most: int):
    names = ["a", "b"]

    def run(rows: pa.Table) -> pa.Table:
        fp, home, left, right = (rows.column(c).to_numpy() for c in ("fp", "home", "left", "right"))
        fp = fp.view(np.uint64)
        if rows.column("i")[0].as_py() == rows.column("j")[0].as_py():
            pairs = [(fp[home], fp)]
        else:
            pairs = [(fp[left & home], fp[right]), (fp[left & ~home], fp[right & home])]
        linked = [np.zeros(0, np.uint64)]
        for a, b in pairs:
            if len(a) and len(b):
                x, y = _near(a, b, most)
                linked += [a[x], b[y]]
        found = np.array(list(forest(np.concatenate(linked), most)), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1])], names=names)

    return run


def links(prints: DataFrame, n: int, most: int = 4) -> DataFrame:
    """(a, b): links among distinct fingerprints fp, n of them, that join exactly what pairs at most bits or fewer join."""
    sample = np.array([r["fp"] for r in prints.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)  # bounded
    if not len(sample):
        return cut(prints.select(F.col("fp").alias("a"), F.col("fp").alias("b")), "links")
    depth = max(3, int(np.ceil(np.log2(max(1, n / SHARD)))))
    trees = [_shards(F.col("fp"), t, _levels(sample, a, b, depth), budget) for t, (a, b, budget) in enumerate(blocks(most))]
    placed = cut(prints.select("fp", F.explode(F.concat(*trees)).alias("s")).select("fp", "s.tree", "s.shard", "s.home"), "shards")
    hot = cut(placed.groupBy("tree", "shard").agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK).withColumn("parts", F.ceil(F.col("rows") / BLOCK).cast("int")), "hot")
    # A row of a shard of p parts goes to the p pairs of blocks that hold its own.
    dealt = look_up(placed, hot, ["tree", "shard"], "rows", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select("fp", "home", "tree", "shard", i.alias("i"), j.alias("j"), (F.col("own") == i).alias("left"), (F.col("own") == j).alias("right"))
    out = cut(dealt.groupBy("tree", "shard", "i", "j").applyInArrow(_compared(most), "a long, b long"), "links")
    drop(placed)
    drop(hot)
    return out


def cluster(docs: DataFrame, shingle: int = 4, seed: int = 42, most: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs: 16 hex digits, and the least doc_id that links reach.

    Null, empty and blank texts have fingerprint zero and are linked like any other. Rows that share a doc_id each keep a row; rows
    with a null doc_id are linked too and have the least doc_id of the others, null if there is none. An empty table gives no rows;
    other columns are not read. Texts are read whole, in pieces of PIECE bytes between words.
    """
    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType())])
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_fingerprints(shingle, seed), kind), "prints")
    seen = Observation()
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("id"), F.count("*").alias("rows")).observe(seen, F.count("*").alias("n")), "vertices")
    found = links(prints, seen.get["n"], most)
    told = cut(components(found).select(F.col("id").alias("fp"), "component"), "parts")
    drop(found)
    joined = prints.join(told, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("id").alias("component_id"), F.count("*").alias("members"))
    least = cut(least, "least")
    named = cut(look_up(joined, least, ["component"], "members").select("fp", "component_id", "rows"), "named")
    for x in (told, prints, least):
        drop(x)
    return look_up(rows, named, ["fp"], "rows").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
