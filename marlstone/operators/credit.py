"""Step credit: what rows of a turn are worth, which of them count, and how groups are filtered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .advantage import leave_one_out, reward_to_go, whitened
from .rows import numbered


def multi_source(rows: DataFrame, group: list[str], sequence: list[str], order: list[str], sources: dict[str, float], mask: str | None = None) -> DataFrame:
    """Adds ``advantage``: leave-one-out of each reward source within its group, weighted, summed from each row to its sequence's end, whitened."""
    total = None
    for name, weight in sources.items():
        part = leave_one_out(F.col(name), group) * weight
        total = part if total is None else total + part
    out = rows.withColumn("_r", total).withColumn("_g", reward_to_go(F.col("_r"), sequence, order))
    return whitened(out, "_g", mask, out="advantage").drop("_r", "_g")


def fused(advantage: Column, local: Column, weight: float, active: Column, reliable: Column) -> Column:
    """The global advantage plus the weighted local one on rows that are active and whose span is reliable."""
    return advantage + F.when(active & reliable, weight * F.coalesce(local, F.lit(0.0))).otherwise(0.0)


def contiguous_turns(rows: DataFrame, keys: list[str], index: str) -> DataFrame:
    """The rows of groups whose indices are 0 .. n - 1, each once."""
    w = Window.partitionBy(*keys)
    parts = {"_low": F.min(index).over(w), "_high": F.max(index).over(w), "_n": F.count("*").over(w), "_kinds": F.size(F.collect_set(index).over(w))}
    return rows.withColumns(parts).where("_low = 0 AND _high = _n - 1 AND _kinds = _n").drop(*parts)


def before_answer(rows: DataFrame, keys: list[str], index: str, answer: Column) -> DataFrame:
    """The rows before the answer, of groups in which an answer, if there is one, is the only one and last."""
    return _answered(rows, keys, index, answer).where("_placed AND NOT _is_answer").drop(*ANSWERED)


def misplaced_answers(rows: DataFrame, keys: list[str], index: str, answer: Column) -> DataFrame:
    """groups, dropped: how many groups there are, and how many have several answers or rows behind one."""
    per = _answered(rows, keys, index, answer).groupBy(*keys).agg(F.min("_placed").alias("_placed"))
    return per.agg(F.count("*").alias("groups"), F.count_if(~F.col("_placed")).alias("dropped"))


ANSWERED = ["_is_answer", "_answers", "_at", "_last", "_placed"]


def _answered(rows: DataFrame, keys: list[str], index: str, answer: Column) -> DataFrame:
    w = Window.partitionBy(*keys)
    out = rows.withColumn("_is_answer", F.coalesce(answer, F.lit(False)))
    out = out.withColumns({"_answers": F.count_if("_is_answer").over(w), "_at": F.max(F.when(F.col("_is_answer"), F.col(index))).over(w), "_last": F.max(index).over(w)})
    return out.withColumn("_placed", (F.col("_answers") == 0) | ((F.col("_answers") == 1) & (F.col("_at") == F.col("_last"))))


def follows(rows: DataFrame, keys: list[str], order: list[str], condition: Column, out: str = "follows") -> DataFrame:
    """Adds whether the row before meets a condition."""
    return rows.withColumn(out, F.coalesce(F.lag(condition).over(Window.partitionBy(*keys).orderBy(*order)), F.lit(False)))


def trial_and_last(rows: DataFrame, key: str, order: list[str], value: str, trial: int) -> DataFrame:
    """Of each key: number of observations, the trial-th one (null where there are fewer) and the last."""
    w = Window.partitionBy(key).orderBy(*order)
    turned = rows.select(key, value, F.row_number().over(w).alias("_k"))
    return turned.groupBy(key).agg(F.count("*").alias("observations"), F.max(F.when(F.col("_k") == trial, F.col(value))).alias("trial"), F.max_by(value, "_k").alias("last"))


def retirement(trial: Column, last: Column, too_hard: float, mastered: float) -> Column:
    """Why a candidate retires, if it does: too hard at its trial, drifted to too hard, or mastered."""
    return F.when(trial < too_hard, "trial_too_hard").when(last < too_hard, "drift_too_hard").when(last > mastered, "mastered")


def banded_groups(rows: DataFrame, group: str, score: str, truncated: Column, low: float, high: float, oversample: float) -> DataFrame:
    """group, passed: 1 / oversample of the groups, those with a mean score in the band and nothing truncated first."""
    found = rows.groupBy(group).agg((F.avg(score).between(low, high) & ~F.max(truncated)).alias("passed"))
    keep = int(found.count() / oversample)
    placed = numbered(found.withColumn("_after", ~F.col("passed")), ["_after", group], "_nth")  # what is kept grows with the data, so no task gathers it
    return placed.where(F.col("_nth") < keep).drop("_after", "_nth")


def scaled_by_largest(rows: DataFrame, keys: list[str], order: list[str], reward: str, out: str = "scaled") -> DataFrame:
    """Rewards divided by the largest absolute sum from any row to its sequence's end."""
    gone = rows.withColumn("_g", reward_to_go(F.col(reward), keys, order))
    largest = gone.agg(F.max(F.abs("_g")).alias("_m"))
    return gone.crossJoin(F.broadcast(largest)).withColumn(out, F.col(reward) / F.nullif(F.col("_m"), F.lit(0.0))).drop("_g", "_m")  # one row


def by_lot(seed: int, *keys: str) -> Column:
    """A lot that depends on the seed and the keys alone: the same at every partitioning and on every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]).cast("binary"))


def drawn_from_band(rows: DataFrame, value: Column, low: float, high: float, share: float, key: str, seed: int) -> DataFrame:
    """max(1, share of all rows) rows drawn by lot among those with a value strictly between the bounds."""
    keep = max(1, int(rows.count() * share))
    placed = numbered(rows.where((value > low) & (value < high)).withColumn("_lot", by_lot(seed, key)), ["_lot", key], "_nth")
    return placed.where(F.col("_nth") < keep).drop("_lot", "_nth")


def shuffled(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """All rows in an order by lot (a range-partitioned sort)."""
    return rows.orderBy(by_lot(seed, key), key)


def resampled(rows: DataFrame, keys: list[str], item: str, weight: Column, draws: int, seed: int, bins: int = 64) -> DataFrame:
    """keys, draw, item: ``draws`` draws with replacement within each group, with chances by weight.

    Items cover intervals of the cumulated weights; draws fall into bins, so each is joined to its bin's items only.
    """
    w = Window.partitionBy(*keys)
    up = F.sum("_w").over(w.orderBy(item).rowsBetween(Window.unboundedPreceding, 0))
    edges = rows.select(*keys, item, weight.cast("double").alias("_w")).where("_w > 0").withColumns({"_to": up, "_all": F.sum("_w").over(w)})
    edges = edges.withColumn("_to", F.when(F.row_number().over(w.orderBy(F.desc(item))) == 1, 1.0).otherwise(F.col("_to") / F.col("_all")))
    edges = edges.withColumn("_from", F.coalesce(F.lag("_to").over(w.orderBy(item)), F.lit(0.0)))
    binned = edges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_from") * bins), F.floor(F.col("_to") * bins))))
    lots = rows.select(*keys).distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    at = F.conv(F.substring(by_lot(seed, *keys, "draw"), 1, 8), 16, 10).cast("double") / 4294967296.0
    lots = lots.withColumn("_u", at).withColumn("_bin", F.floor(F.col("_u") * bins))
    return lots.join(binned, [*keys, "_bin"]).where("_u >= _from AND _u < _to").select(*keys, "draw", item)


def best_per_dimension(rows: DataFrame, key: str, dimensions: list[str]) -> DataFrame:
    """dimension, key, value: the largest of each dimension in turn, no row twice (ties: smallest key)."""
    out, left = None, rows
    for name in dimensions:  # a job for each dimension, one row back
        best = left.orderBy(F.desc(name), key).limit(1).select(F.lit(name).alias("dimension"), key, F.col(name).cast("double").alias("value"))
        out = best if out is None else out.unionByName(best)
        left = left.join(F.broadcast(best.select(key)), key, "left_anti")
    return out


def middle(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each group the row at place n // 2 after sorting."""
    w = Window.partitionBy(*keys)
    return rows.withColumns({"_k": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w)}).where("_k = floor(_n / 2) + 1").drop("_k", "_n")
