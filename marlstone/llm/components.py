"""Connected components by alternating large-star and small-star steps; DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: A node with more than this share of all edge ends is a hub; there are at most 1 / SHARE of them.
SHARE = 1 / 512


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _minima(rows: DataFrame) -> DataFrame:
    return rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _lowered(rows: DataFrame, least: DataFrame, ends: int) -> DataFrame:
    """Every (u, v) with ``m``, the smallest v of its u. Hubs' minima (1 / SHARE rows at most) are broadcast, so no task gets a hub's edges."""
    hubs = least.where(F.col("n") > ends * SHARE).select(F.col("u").alias("k"), "m")
    others = least.where(F.col("n") <= ends * SHARE).select(F.col("u").alias("k"), "m")
    of_hub = rows.join(F.broadcast(hubs), F.col("u") == F.col("k"))
    of_other = rows.join(F.broadcast(hubs.select("k")), F.col("u") == F.col("k"), "left_anti").join(others.hint("merge"), F.col("u") == F.col("k"))
    return of_hub.unionByName(of_other).drop("k")


def connected_components(edges: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node reachable) for every node with an edge to another one.

    Edges with a null end and loops are ignored; repeated edges and either direction count once. Each round is
    written to the shared folder. Minima are taken before anything is shuffled, so a hub costs a row a task.
    """
    e = scratch.cut(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = _mark(e)
    while mark[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = scratch.cut(_lowered(both, _minima(both), 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        # the smallest neighbour keeps its edge, every other one is moved to it
        made = scratch.cut(_lowered(large, _minima(large), mark[0]).select(F.when(F.col("v") > F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v")).distinct())
        now = _mark(made)
        scratch.drop(e)
        scratch.drop(large)
        e, before, mark = made, mark, now
        if now == before:
            break
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
