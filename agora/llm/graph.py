"""Connected components of an edge table, in rounds of large stars and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from agora.llm.shared import BROADCAST_ROWS, cut, drop, look_up


def _lowest(links: DataFrame, edges: int, held: list[DataFrame]) -> DataFrame:
    """links (u, v) with m, the least of u and its neighbours, which are combined before the shuffle. Of few edges the vertices are
    broadcast; of many they are written and looked up, vertices with very many links by a broadcast of their own."""
    low = links.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    if 2 * edges <= BROADCAST_ROWS:
        return links.join(F.broadcast(low.drop("n")), "u")
    held.append(cut(low, "lowest"))
    return look_up(links, held[-1], ["u"], "n")


def _both(edges: DataFrame) -> DataFrame:
    """Each edge from either end, without one shuffle more."""
    pair = F.array(F.struct(F.col("u"), F.col("v")), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))
    return edges.select(F.explode(pair).alias("p")).select("p.u", "p.v")


def _kept(edges: DataFrame) -> tuple[DataFrame, dict]:
    """edges, written, with their number and a sum of their hashes, which are taken on the way."""
    seen = Observation()
    told = edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
    return cut(told, "edges"), seen.get


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(id, component) for every vertex of edges (a, b) but those that are alone; component is the least id reached.

    Each round looks every link's vertex up twice, and no vertex's links meet in one task.
    An empty edge table gives no rows; loops, repeated edges and edges with a null end count for nothing.
    """
    now, state = _kept(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u <> v").distinct())
    for _ in range(rounds):
        if not state["n"]:
            break
        links, held = _both(now), []
        large = _lowest(links, state["n"], held).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        star = _lowest(large, state["n"], held).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after, found = _kept(star)
        for table in (now, *held):
            drop(table)
        now, state, before = after, found, state
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
