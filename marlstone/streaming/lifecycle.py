"""Streams of candidate samples: cooldown, epoch-delayed admission, exactly-once journals, work state, rates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_cooldown(stream: DataFrame, key: str, step: str, wait: int) -> DataFrame:
    """key, step of the records that are at least ``wait`` steps after the key's last emitted one (state: that step)."""
    kind = stream.schema[key].dataType.simpleString()

    def emit(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for s in sorted(int(x) for p in parts for x in p[step]):
            if last is None or s - last >= wait:
                last = s
                out.append((k[0], s))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, step])

    return stream.select(key, F.col(step).cast("long").alias(step)).groupBy(key).applyInPandasWithState(emit, f"`{key}` {kind}, `{step}` long", "last long", "append", GroupStateTimeout.NoTimeout)


#: The transitions of a piece of work; terminal states absorb.
TRANSITIONS = {("PENDING", "start"): "RUNNING", ("RUNNING", "succeed"): "SUCCEEDED", ("RUNNING", "drop"): "DROPPED", ("RUNNING", "defer"): "PENDING", ("RUNNING", "crash"): "PENDING"}


def tracked(stream: DataFrame, key: str, order: str, event: str) -> DataFrame:
    """key, status, attempts after each micro-batch: the state machine of TRANSITIONS; other events change nothing."""
    kind = stream.schema[key].dataType.simpleString()

    def advance(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts = state.get if state.exists else ("PENDING", 0)
        for e in pd.concat(list(parts)).sort_values(order)[event]:
            new = TRANSITIONS.get((status, e), status)
            attempts += (status, new) == ("PENDING", "RUNNING")
            status = new
        state.update((status, attempts))
        yield pd.DataFrame([(k[0], status, attempts)], columns=[key, "status", "attempts"])

    return stream.select(key, order, event).groupBy(key).applyInPandasWithState(advance, f"`{key}` {kind}, status string, attempts int", "status string, attempts int", "update", GroupStateTimeout.NoTimeout)


def observed(stream: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key, n, first, last, mean of a key's observations so far (state: count, ends and sum, never the list)."""
    kind = stream.schema[key].dataType.simpleString()

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, last, total = state.get if state.exists else (0, None, None, 0.0)
        for x in pd.concat(list(parts)).sort_values(order)[value].astype(float):
            n, first, last, total = n + 1, x if first is None else first, x, total + x
        state.update((n, first, last, total))
        yield pd.DataFrame([(k[0], n, first, last, total / n)], columns=[key, "n", "first", "last", "mean"])

    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(fold, f"`{key}` {kind}, n long, first double, last double, mean double", "n long, first double, last double, total double", "update", GroupStateTimeout.NoTimeout)


def journal(stream: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """The first record of each key; state is dropped once the watermark has passed a key's time."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def journaled(held: DataFrame, new: DataFrame, key: str, content: list[str]) -> tuple[DataFrame, DataFrame]:
    """(fresh, conflicts) of a micro-batch against the journal: one row for each key that isn't held, and the rows of keys whose content differs.

    Content is compared with what is held, else with the smallest content of the batch; an equal record is no news.
    """
    held = held.select(F.col(key).alias("_k"), F.struct(*content).alias("_held"))
    rows = new.withColumn("_own", F.struct(*content))
    firsts = rows.groupBy(F.col(key).alias("_f")).agg(F.min("_own").alias("_first"))
    told = rows.join(held, F.col(key).eqNullSafe(F.col("_k")), "left").join(firsts, F.col(key).eqNullSafe(F.col("_f")))
    fresh = told.where("_k IS NULL AND _own <=> _first").dropDuplicates([key]).select(new.columns)
    return fresh, told.where(~F.col("_own").eqNullSafe(F.coalesce("_held", "_first"))).select(new.columns)


def windowed(stream: DataFrame, time: str, width: str, late: str, by: list[str], **measures) -> DataFrame:
    """Measures over tumbling windows of event time, final once the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(*[m.alias(n) for n, m in measures.items()])


def admitted(pool: DataFrame, ready: DataFrame, epoch: int, share: float, cap: int, order: list[str]) -> DataFrame:
    """Candidates of earlier epochs in queue order, at most ``share`` of the pool and what is free below ``cap``.

    The limit is global, so this runs on a micro-batch in foreachBatch and not on keyed state.
    """
    size = pool.agg(F.count("*").alias("_size"))
    free = F.least(F.floor(F.col("_size") * share), F.lit(cap) - F.col("_size"))
    waiting = ready.where(F.col("epoch") < epoch).join(pool.select("candidate_id"), "candidate_id", "left_anti").dropDuplicates(["candidate_id"])
    first = waiting.orderBy(*order).limit(cap)  # more are never admitted
    return first.withColumn("_n", F.row_number().over(Window.orderBy(*order))).join(F.broadcast(size)).where(F.col("_n") <= free).drop("_n", "_size")


def retirement(mean: str, n: str, age: str, trial: int, stale: int):
    """Why a candidate leaves the pool: too hard on trial, mastered, or stale; null while it stays."""
    return F.when((F.col(n) >= trial) & (F.col(mean) < 0.2), "too_hard").when((F.col(n) >= trial) & (F.col(mean) > 0.85), "mastered").when(F.col(age) > stale, "stale")


def counter_rates(rows: DataFrame, key: str, time: str, counter: str) -> DataFrame:
    """Adds ``rate``: the counter's change a second since the key's last sample; null at the first and at resets."""
    w = Window.partitionBy(key).orderBy(time)
    seconds = F.col(time).cast("timestamp").cast("double") - F.lag(F.col(time).cast("timestamp").cast("double")).over(w)
    change = F.col(counter) - F.lag(counter).over(w)
    return rows.withColumn("rate", F.when(change >= 0, F.try_divide(change, seconds)))


def run_once(frame: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None] | None = None, sink: str | None = None, mode: str = "append") -> None:
    """All that is available now, then stop; ``handle`` gets each micro-batch, or ``sink`` is a folder of Parquet."""
    writer = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (writer.foreachBatch(handle).start() if handle else writer.format("parquet").start(sink)).awaitTermination()
