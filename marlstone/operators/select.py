"""Selection: quotas, boundary priorities, top-k, shards, exact stratified samples, evictions, packing."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouped import map_groups


def capability(progress: Column) -> Column:
    """too_hard below 0.2, boundary up to 0.85, mastered beyond; outside 0 to 1 raises."""
    return F.when(~progress.between(0, 1), F.raise_error(F.concat(F.lit("progress out of range: "), progress.cast("string")))).when(progress < 0.2, "too_hard").when(progress <= 0.85, "boundary").when(progress.isNotNull(), "mastered")


def boundary_priority(progress: Column) -> Column:
    """4p(1 - p)."""
    return 4 * progress * (1 - progress)


def ranked_quota(rows: DataFrame, group: str, order: list[Column], quota: Column | int, total: int | None = None) -> DataFrame:
    """The best rows of each group up to its quota, then up to ``total`` over all; what a group leaves isn't given to others."""
    out = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= quota)
    return out if total is None else out.orderBy(*order).limit(total)


def first_seen(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")


def interleaved(rows: DataFrame, group: str, order: list[Column], most: int, total: int) -> DataFrame:
    """Round robin over groups: all firsts, then all seconds, at most ``most`` of a group and ``total`` in all."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= most)
    return ranked.orderBy("rank", group).limit(total)


def shard_by_rank(rows: DataFrame, group: str, order: list[Column], shards: int = 2) -> DataFrame:
    """Adds ``shard``: a row's rank in its group modulo ``shards``."""
    return rows.withColumn("shard", F.pmod(F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1, F.lit(shards)))


def stratified_sample(rows: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows of each group (all, if fewer), by a seeded hash of the key; the same rows on any cluster."""
    mixed = F.xxhash64(F.col(key), F.lit(seed))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(mixed, key))).where(F.col("_n") <= n).drop("_n")


def evicted(rows: DataFrame, priority: str, order: list[Column], excess: int) -> DataFrame:
    """The ``excess`` rows of the smallest priority; rows without one are never chosen."""
    return rows.where(F.col(priority).isNotNull()).orderBy(F.asc(priority), *order).limit(excess)


def informative_groups(rows: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Rows of groups whose scores vary, and groups of one."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("_sd", F.stddev_pop(score).over(w)).withColumn("_n", F.count("*").over(w)).where("_sd > 0 OR _n = 1").drop("_sd", "_n")


def _schema(rows: DataFrame, keys: list[str], item: str) -> str:
    return ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in [*keys, item])


def packed(rows: DataFrame, keys: list[str], item: str, length: str, cap: int) -> DataFrame:
    """keys, item, bin, load: best fit of decreasing lengths into bins of ``cap``; an item above it raises.

    A group is a training batch, whose size a task holds by nature.
    """

    def fit(key: tuple, found: list[tuple]) -> list[tuple]:
        loads: list[int] = []
        out = []
        for n, i in sorted(found, key=lambda r: (-r[0], r[1])):
            if n > cap:
                raise ValueError(f"item {i} of length {n} is above the cap of {cap}")
            room = [(cap - load - n, b) for b, load in enumerate(loads) if load + n <= cap]
            b = min(room)[1] if room else len(loads)
            if not room:
                loads.append(0)
            loads[b] += n
            out.append((i, b))
        return [(*key, i, b, loads[b]) for i, b in out]

    return map_groups(_lengths(rows, keys, item, length), keys, ["_n", item], fit, f"{_schema(rows, keys, item)}, bin int, load long")


def _lengths(rows: DataFrame, keys: list[str], item: str, length: str) -> DataFrame:
    return rows.select(*keys, item, F.col(length).cast("long").alias("_n"))


def differenced(items: list[tuple], parts: int, equal: bool = False) -> list[list]:
    """Items of (length, item), ascending, in parts of like totals: the two most uneven partial solutions are merged against each other."""
    if equal and len(items) % parts:
        raise ValueError(f"{len(items)} items can't be dealt evenly to {parts} parts")
    starts = [items[k : k + parts] for k in range(0, len(items), parts)] if equal else [[x] for x in items]
    heap = []
    for n, start in enumerate(starts):
        sets = sorted([(x[0], [x[1]]) for x in start] + [(0, [])] * (parts - len(start)), key=lambda s: -s[0])
        heapq.heappush(heap, (sets[-1][0] - sets[0][0], n, sets))
    n = len(starts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        sets = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda s: -s[0])
        heapq.heappush(heap, (sets[-1][0] - sets[0][0], n, sets))
        n += 1
    return [held for _, held in heap[0][2]]


def balanced(rows: DataFrame, keys: list[str], item: str, length: str, parts: int, equal: bool = False) -> DataFrame:
    """keys, item, part: differencing (largest two sets merged against each other) into parts of like totals."""
    split = lambda key, items: [(*key, i, p) for p, held in enumerate(differenced(items, parts, equal)) for i in held]
    return map_groups(_lengths(rows, keys, item, length), keys, ["_n", item], split, f"{_schema(rows, keys, item)}, part int")


def least_loaded(rows: DataFrame, keys: list[str], item: str, length: str, parts: int) -> DataFrame:
    """keys, item, part: items in their order, each to the part with the least so far."""

    def deal(key: tuple, found: list[tuple]) -> list[tuple]:
        heap = [(0, p) for p in range(parts)]
        out = []
        for i, n in found:
            load, p = heapq.heappop(heap)
            heapq.heappush(heap, (load + n, p))
            out.append((*key, i, p))
        return out

    return map_groups(_lengths(rows, keys, item, length), keys, [item, "_n"], deal, f"{_schema(rows, keys, item)}, part int")


def minibatches(rows: DataFrame, order: list[str], size: int, groups: str | None = None, drop_last: bool = True) -> DataFrame:
    """Adds ``batch``: runs of ``size`` rows in order within ``groups``; a last incomplete batch is dropped on request."""
    w = Window.partitionBy(*([groups] if groups else [F.lit(0)]))
    out = rows.withColumn("_n", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_of", F.count("*").over(w)).withColumn("batch", F.floor(F.col("_n") / size).cast("int"))
    return (out.where(F.col("batch") < F.floor(F.col("_of") / size)) if drop_last else out).drop("_n", "_of")
