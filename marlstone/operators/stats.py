"""Statistics of runs: masked moments, percentiles, majority votes, bootstrap intervals, two-level reports."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def masked_mean(value: Column, mask: Column, eps: float = 1e-8) -> Column:
    m = mask.cast("double")
    return F.sum(value * m) / (F.sum(m) + eps)


def mean_or_zero(value: Column) -> Column:
    """The mean; 0 of nothing."""
    return F.coalesce(F.avg(value), F.lit(0.0))


def rms_or_zero(value: Column) -> Column:
    return F.coalesce(F.sqrt(F.avg(value * value)), F.lit(0.0))


def soft_mean(value: Column, beta: float) -> Column:
    """log(mean(exp(beta * x))) / beta, and the mean at beta 0."""
    return F.avg(value) if beta == 0 else F.log(F.avg(F.exp(beta * value))) / beta


def rounded_rank_percentile(value: Column, fraction: float) -> Column:
    """The value at rank round((n - 1) * fraction), halves to even; null of nothing."""
    ordered = F.array_sort(F.collect_list(value))
    return F.try_element_at(ordered, F.bround((F.size(ordered) - 1) * F.lit(fraction), 0).cast("int") + 1)


def linear_percentile(value: Column, percent: float) -> Column:
    return F.percentile(value, F.lit(percent / 100.0))


def reduced_metrics(long: DataFrame, name: str, value: str) -> DataFrame:
    """metric, value: the maximum where the name has ``max``, the minimum where it has ``min``, else the mean."""
    n = F.lower(F.col(name))
    reduced = F.when(F.first(n).contains("max"), F.max(value)).when(F.first(n).contains("min"), F.min(value)).otherwise(F.avg(value))
    return long.groupBy(name).agg(reduced.alias("value"))


def majority_vote(rows: DataFrame, keys: list[str], vote: str, value: str, order: str) -> DataFrame:
    """keys, vote, votes, value: the most frequent vote (the earliest of equals) and its first value."""
    counted = rows.groupBy(*keys, vote).agg(F.count("*").alias("votes"), F.min(order).alias("_at"), F.min_by(value, order).alias(value))
    best = Window.partitionBy(*keys).orderBy(F.desc("votes"), "_at")
    return counted.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").drop("_rank", "_at")


def two_levels(rows: DataFrame, category: str, measures: dict[str, Column], overall: str = "overall") -> DataFrame:
    """Measures for each category and for all rows (grouping sets)."""
    return rows.rollup(category).agg(F.grouping(category).alias("_all"), *[m.alias(n) for n, m in measures.items()]).withColumn(category, F.when(F.col("_all") == 1, overall).otherwise(F.col(category).cast("string"))).drop("_all")


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits stirred (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Chances of a Poisson(1) weight of at most 0, 1, ... 11.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])


def bootstrap_interval(rows: DataFrame, keys: list[str], value: str, order: str, draws: int = 2000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """keys, mean, lower, upper: a percentile interval of the mean from seeded resamples of each group.

    A row's weight in a draw is Poisson(1), by a lot of the seed, the draw, ``order`` (which names a row of a group)
    and the keys: what a resample of a large group tends to, and the same at every partitioning. Tasks add up
    weighted sums, so a group may have any size; a draw without any weight is the mean.
    """
    low, high = int((1 - level) / 2 * draws), int((1 + level) / 2 * draws) - 1
    named = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x"), F.xxhash64(F.lit(seed), *keys, order).alias("_lot"))
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    stirred = _mixed(np.arange(1, draws + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    kept = to_arrow_schema(named.select(*keys).schema)
    out = pa.schema([*kept, ("_w", pa.list_(pa.float64())), ("_wx", pa.list_(pa.float64())), ("_n", pa.int64()), ("_sum", pa.float64())])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 1024):  # weights of a step are held at once
                part = whole.slice(start, 1024)
                lots = _mixed(part.column("_lot").to_numpy().view(np.uint64)[:, None] ^ stirred[None, :])
                weights, x = np.searchsorted(POISSON, (lots >> np.uint64(11)) * 2.0**-53).astype(float), part.column("_x").to_numpy()
                groups: dict[tuple, list[int]] = {}
                for k, key in enumerate(zip(*[part.column(c).to_pylist() for c in keys], strict=True)):
                    groups.setdefault(key, []).append(k)
                found = [(*key, weights[at].sum(0), x[at] @ weights[at], len(at), float(x[at].sum())) for key, at in groups.items()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), out, strict=True)], schema=out)

    parts = named.mapInArrow(weigh, f"{kinds}, _w array<double>, _wx array<double>, _n long, _sum double")
    means = parts.groupBy(*keys).agg((F.sum("_sum") / F.sum("_n")).alias("mean"))
    drawn = parts.select(*keys, F.posexplode(F.arrays_zip("_w", "_wx")).alias("draw", "s")).groupBy(*keys, "draw").agg(F.sum("s._w").alias("w"), F.sum("s._wx").alias("wx"))
    ends = drawn.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("w", "wx"))).alias("d"))  # ``draws`` of them
    same = [F.col(f"e.{k}").eqNullSafe(F.col(f"m.{k}")) for k in keys]
    both = means.alias("m").join(ends.alias("e"), same).select(*[F.col(f"m.{k}") for k in keys], "mean", F.array_sort(F.transform("d", lambda x: F.coalesce(F.try_divide(x["wx"], x["w"]), F.col("mean")))).alias("d"))
    return both.select(*keys, "mean", F.get("d", F.lit(low)).alias("lower"), F.get("d", F.lit(high)).alias("upper"))


def best_of_n(rows: DataFrame, keys: list[str], value: str, sizes: list[int]) -> DataFrame:
    """keys, n, best, worst: the exact expectation of the best and the worst of n draws with replacement from each group.

    Equal values are counted first; a group's distinct values are ordered in one task.
    """
    tied = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    w = Window.partitionBy(*keys)
    upto = F.sum("_c").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)) / F.sum("_c").over(w)
    ranked = tied.withColumn("_to", upto).withColumn("_from", F.coalesce(F.lag("_to").over(w.orderBy(value)), F.lit(0.0)))
    listed = ranked.withColumn("n", F.explode(F.array(*[F.lit(n) for n in sizes])))
    x = F.col(value).cast("double")
    best = F.sum(x * (F.pow("_to", "n") - F.pow("_from", "n")))
    worst = F.sum(x * (F.pow(1 - F.col("_from"), "n") - F.pow(1 - F.col("_to"), "n")))
    return listed.groupBy(*keys, "n").agg(best.alias("best"), worst.alias("worst"))


def bootstrapped(rows: DataFrame, keys: list[str], value: str, order: str, size: int, reducers: dict[str, Callable[[Column], Column]], draws: int = 1000, seed: int = 42) -> DataFrame:
    """keys and, for each reducer, its mean and population deviation (name_std) over seeded resamples of ``size`` values.

    A reducer takes the column of a resample's values (an array) to a number: Spark's functions or an Arrow
    function of one's own. Resamples depend on the seed, the keys, the draw and the place alone. A group (the
    answers to a prompt) is an array; each resample is a row of ``size`` values.
    """
    held = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("_values"))
    drawn = held.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    lot = lambda j: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.col("_draw").cast("string"), j.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    picked = drawn.withColumn("_picked", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.get("_values", (lot(j) % F.size("_values")).cast("int"))))
    told = picked.select(*keys, *[f(F.col("_picked")).cast("double").alias(n) for n, f in reducers.items()])
    return told.groupBy(*keys).agg(*[x for n in reducers for x in (F.avg(n).alias(n), F.stddev_pop(n).alias(f"{n}_std"))])


def loss_mean(rows: DataFrame, sequence: str, loss: str, mask: str, mode: str = "token-mean", norm: float | None = None) -> DataFrame:
    """loss: over tokens, or over sequences of their token sums or means."""
    m = F.col(mask).cast("double")
    if mode == "token-mean":
        return rows.agg((F.sum(F.col(loss) * m) / F.sum(m)).alias("loss"))
    per = rows.groupBy(sequence).agg(F.sum(F.col(loss) * m).alias("s"), F.sum(m).alias("n"))
    if mode == "seq-mean-token-sum":
        return per.agg(F.avg("s").alias("loss"))
    if mode == "seq-mean-token-mean":
        return per.agg(F.avg(F.try_divide("s", "n")).alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        return per.agg((F.sum("s") / F.lit(float(norm))).alias("loss"))
    raise ValueError(f"unknown mode {mode}")


def pass_rates(rows: DataFrame, keys: list[str], score: Column) -> DataFrame:
    """Per group: n, population variance (0 below two), and whether rewards vary, are all zero or all one."""
    spread = F.when(F.count("*") < 2, 0.0).otherwise(F.var_pop(score))
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), spread.alias("variance"), (F.max(score) == 0).alias("all_zero"), (F.min(score) == 1).alias("all_one"))
