"""Micro-batches of the ranks of a training batch: how many, what goes where, and in which order.

Counts are aggregates over all batches at once. What is split is one rank's share of one batch, which a task holds
by nature; batches and ranks are dealt to tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grouped import map_groups
from .select import _schema, differenced, packed


def _rounded(n: Column, multiple: int) -> Column:
    return (F.ceil(n / multiple) * multiple).cast("int")


def micro_counts(rows: DataFrame, keys: list[str], rank: str, length: str, cap: int, least: int = 1, multiple: int = 1, alike: bool = True) -> DataFrame:
    """keys, rank, items, total, longest, parts: ceil(total / cap) micro-batches, no more than items, ``least`` at least.

    ``alike``: all ranks of a batch take the largest number. Numbers are rounded up to a ``multiple``.
    """
    found = rows.groupBy(*keys, rank).agg(F.count("*").alias("items"), F.sum(length).cast("long").alias("total"), F.max(length).cast("long").alias("longest"))
    own = F.greatest(F.least(F.col("items"), F.ceil(F.col("total") / cap)), F.lit(least))
    number = F.max(own).over(Window.partitionBy(*keys)) if alike else own  # a row for each rank
    return found.withColumn("parts", _rounded(number, multiple))


def micro_batches(rows: DataFrame, keys: list[str], rank: str, item: str, length: str, cap: int, least: int = 1, multiple: int = 1, alike: bool = True) -> DataFrame:
    """keys, rank, item, part: as many parts as micro_counts says, with like totals (a part may exceed ``cap`` a little).

    An item above the cap, or more parts than items, raises.
    """
    counts = micro_counts(rows, keys, rank, length, cap, least, multiple, alike)
    held = rows.select(*keys, rank, item, F.col(length).cast("long").alias("_n")).join(counts.select(*keys, rank, "parts", "longest"), [*keys, rank])

    def split(key: tuple, found: list[tuple]) -> list[tuple]:
        *name, parts, longest = key
        if longest > cap:
            raise ValueError(f"an item of length {longest} is above the cap of {cap}")
        if parts > len(found):
            raise ValueError(f"{len(found)} items can't fill {parts} micro-batches")
        return [(*name, i, p) for p, held in enumerate(differenced(found, parts)) for i in held]

    return map_groups(held, [*keys, rank, "parts", "longest"], ["_n", item], split, f"{_schema(rows, [*keys, rank], item)}, part int")


def strict_micro_batches(rows: DataFrame, keys: list[str], rank: str, item: str, length: str, cap: int, least: int = 1, multiple: int = 1, alike: bool = True) -> DataFrame:
    """keys, rank, item, part: no part above ``cap``; best fit of decreasing lengths, then the fullest parts are split until the number is right.

    The part with the largest total of more than one item (the first of equals) gives its last item, its shortest,
    to a new part. More parts than items raises.
    """
    bins = packed(rows, [*keys, rank], item, length, cap)
    own = F.greatest(F.max("bin") + 1, F.lit(least))
    counts = bins.groupBy(*keys, rank).agg(own.alias("_own"))
    counts = counts.withColumn("parts", _rounded(F.max("_own").over(Window.partitionBy(*keys)) if alike else F.col("_own"), multiple)).drop("_own")
    held = bins.select(*keys, rank, item, "bin").join(rows.select(*keys, rank, item, F.col(length).cast("long").alias("_n")), [*keys, rank, item]).join(counts, [*keys, rank])

    def split(key: tuple, found: list[tuple]) -> list[tuple]:
        *name, target = key
        if target > len(found):
            raise ValueError(f"{len(found)} items can't fill {target} micro-batches")
        parts: list[list[tuple]] = [[] for _ in range(1 + max(b for b, _, _ in found))]
        for b, n, i in sorted(found, key=lambda r: (-r[1], r[2])):
            parts[b].append((n, i))
        loads = [sum(n for n, _ in p) for p in parts]
        while len(parts) < target:
            _, at = max((loads[k], -k) for k, p in enumerate(parts) if len(p) > 1)
            n, i = parts[-at].pop()
            loads[-at] -= n
            parts.append([(n, i)])
            loads.append(n)
        return [(*name, i, p) for p, held in enumerate(parts) for _, i in held]

    return map_groups(held, [*keys, rank, "parts"], ["bin", "_n", item], split, f"{_schema(rows, [*keys, rank], item)}, part int")


def balanced_order(rows: DataFrame, keys: list[str], item: str, length: str, ranks: int) -> DataFrame:
    """keys, item, rank, position: a batch's new order, in which equal runs of positions are ranks of like totals.

    Items must be divisible by ``ranks``; within a rank they ascend. The table is a permutation: sorted by item it
    says where an item goes, sorted by position where it came from.
    """
    held = rows.select(*keys, item, F.col(length).cast("long").alias("_n"))

    def order(key: tuple, found: list[tuple]) -> list[tuple]:
        dealt = [(r, i) for r, members in enumerate(differenced(found, ranks, equal=True)) for i in sorted(members)]
        return [(*key, i, r, p) for p, (r, i) in enumerate(dealt)]

    return map_groups(held, keys, ["_n", item], order, f"{_schema(rows, keys, item)}, rank int, position int")
