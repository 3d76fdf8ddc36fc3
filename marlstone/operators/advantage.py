"""Advantages of grouped rollouts as window expressions, and a registry of the estimators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def _group(keys: list[str]):
    return Window.partitionBy(*keys)


def group_normalised(score: Column, keys: list[str], eps: float = EPS) -> Column:
    """(score - mean) / (sample deviation + eps); a group of one has mean 0 and deviation 1."""
    w = _group(keys)
    n = F.count(score).over(w)
    return F.when(n == 1, score / (1 + eps)).otherwise((score - F.avg(score).over(w)) / (F.stddev_samp(score).over(w) + eps))


def group_centred(score: Column, keys: list[str]) -> Column:
    """score - mean, not scaled; a group of one keeps its score."""
    w = _group(keys)
    return F.when(F.count(score).over(w) == 1, score).otherwise(score - F.avg(score).over(w))


def leave_one_out(score: Column, keys: list[str]) -> Column:
    """The score against the mean of the group's others; a group of one keeps its score."""
    w = _group(keys)
    n = F.count(score).over(w)
    return F.when(n > 1, (score - F.avg(score).over(w)) * n / (n - 1)).otherwise(score)


def length_weighted(score: Column, length: Column, keys: list[str]) -> Column:
    """The score against the length-weighted group mean; the baseline of a group of one is 0."""
    w = _group(keys)
    return F.when(F.count(score).over(w) == 1, score).otherwise(score - F.sum(length * score).over(w) / F.sum(length).over(w))


def best_only(score: Column, order: list[Column], keys: list[str], scaled: bool = False, eps: float = EPS) -> Column:
    """The best row of a group gets its lead over the second best, all others 0; null in groups of one."""
    ranked = _group(keys).orderBy(score.desc(), *order)
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    lead = score - F.nth_value(score, 2).over(whole)
    lead = lead / (F.stddev_samp(score).over(_group(keys)) + eps) if scaled else lead
    return F.when(F.count(score).over(_group(keys)) > 1, F.when(F.row_number().over(ranked) == 1, lead).otherwise(0.0))


def reward_to_go(reward: Column, keys: list[str], order: list[str], baseline: Column | None = None) -> Column:
    """The sum of this and all later rewards of a sequence, less a baseline."""
    total = F.sum(reward).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(0, Window.unboundedFollowing))
    return total - baseline if baseline is not None else total


def discounted_returns(rows: DataFrame, keys: list[str], order: list[str], reward: str, gamma: float = 0.9, mask: str | None = None, out: str = "discounted") -> DataFrame:
    """R_j = r_j + gamma * R_{j+1} within ``keys``; where a mask is given, a masked-out step resets the sum to 0.

    One ordered fold over a sequence's steps: a shuffle on ``keys``, no self-join.
    """
    step = F.struct(*order, F.col(reward).cast("double").alias("_r"), (F.col(mask) if mask else F.lit(True)).alias("_m"), F.struct(*rows.columns).alias("_row"))
    fold = F.expr(
        f"""reverse(aggregate(reverse(_steps), cast(array() as array<double>), (acc, s) -> concat(acc, array(
        CASE WHEN s._m THEN s._r + {gamma}D * coalesce(try_element_at(acc, -1), 0D) ELSE 0D END))))"""
    )
    packed = rows.groupBy(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)]).agg(F.array_sort(F.collect_list(step)).alias("_steps"))
    both = packed.withColumn("_v", fold).select(F.explode(F.arrays_zip("_steps", "_v")).alias("z"))
    return both.select("z._steps._row.*", F.col("z._v").alias(out))


def ragged_normalised(value: Column, keys: list[str], eps: float = EPS) -> Column:
    """Normalised over rows of the same depth; 0 with support below two, equal values or a deviation that isn't finite."""
    w = _group(keys)
    deviation = F.stddev_samp(value).over(w)
    ok = (F.count(value).over(w) >= 2) & (F.min(value).over(w) != F.max(value).over(w)) & (deviation > 0)
    return F.when(ok, (value - F.avg(value).over(w)) / (deviation + eps)).otherwise(0.0)


def gae(rows: DataFrame, keys: list[str], order: list[str], reward: str, value: str, gamma: float = 1.0, lam: float = 0.95, out: str = "advantage") -> DataFrame:
    """Generalised advantage estimation: delta_t + gamma * lam * A_{t+1}."""
    following = F.coalesce(F.lead(value).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(0.0))
    with_delta = rows.withColumn("_delta", F.col(reward) + gamma * following - F.col(value))
    return discounted_returns(with_delta, keys, order, "_delta", gamma * lam, out=out).drop("_delta")


def whitened(rows: DataFrame, value: str, mask: str | None = None, eps: float = 1e-8, out: str = "whitened") -> DataFrame:
    """Mean 0 and variance 1 over the masked rows (Bessel's correction); one row of statistics is joined back. A mask of fewer than two rows raises."""
    m = F.col(mask).cast("double") if mask else F.lit(1.0)
    stats = rows.agg(F.sum(m).alias("_n"), (F.sum(F.col(value) * m) / (F.sum(m) + eps)).alias("_mean"))
    spread = rows.join(F.broadcast(stats)).agg(F.sum((F.col(value) - F.col("_mean")) ** 2 * m).alias("_ss"), F.first("_n").alias("_n"), F.first("_mean").alias("_mean"))
    few = F.raise_error(F.lit("a variance needs two rows in the mask at least")).cast("double")
    variance = F.when(F.coalesce(F.col("_n"), F.lit(0.0)) > 1, F.col("_ss") / (F.col("_n") + eps) * F.col("_n") / (F.col("_n") - 1)).otherwise(few)
    return rows.join(F.broadcast(spread)).withColumn(out, (F.col(value) - F.col("_mean")) / F.sqrt(variance + eps)).drop("_ss", "_n", "_mean")


ESTIMATORS: dict[str, Callable[..., Column]] = {
    "group_normalised": group_normalised,
    "group_centred": group_centred,
    "leave_one_out": leave_one_out,
    "length_weighted": length_weighted,
    "best_only": best_only,
}


def register_estimator(name: str, builder: Callable[..., Column]) -> None:
    if name in ESTIMATORS:
        raise ValueError(f"estimator {name} exists")
    ESTIMATORS[name] = builder


def first_end_mask(is_end: Column, keys: list[str], order: list[str]) -> Column:
    """1 up to and including the first end token of a sequence, then 0."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.when(F.coalesce(F.sum(is_end.cast("int")).over(before), F.lit(0)) == 0, 1).otherwise(0)


def position_ids(mask: Column, keys: list[str], order: list[str]) -> Column:
    """Running number of unmasked tokens from 0; masked ones get 0."""
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (F.sum(mask.cast("int")).over(upto) - 1) * mask.cast("int")


def trailing_zero_runs(rows: DataFrame, step: str, score: str) -> DataFrame:
    """last_step, trailing_zeros: how many of the last steps in a row scored 0."""
    last_hit = rows.where(F.col(score) != 0).agg(F.max(step).alias("_hit"))
    return rows.join(F.broadcast(last_hit)).agg(F.max(step).alias("last_step"), F.count_if(F.col("_hit").isNull() | (F.col(step) > F.col("_hit"))).alias("trailing_zeros"))
