"""Runs of a training job as tables: retries, logs, controllers, quotas and category rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rejected_once(rows: DataFrame, key: str, order: list[str], reason: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with their first reason): a key that was rejected stays so in later rows."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = rows.withColumn("reason", F.first(reason, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL").groupBy(key).agg(F.first("reason").alias("reason"))


def recovered(work: DataFrame, workers: DataFrame, worker: str) -> DataFrame:
    """RUNNING work of workers that are no longer there is PENDING again."""
    alive = workers.select(worker).distinct().withColumn("_alive", F.lit(True))
    lost = (F.col("status") == "RUNNING") & F.col("_alive").isNull()
    return work.join(alive, worker, "left").withColumn("status", F.when(lost, "PENDING").otherwise(F.col("status"))).drop("_alive")


def current_state(log: DataFrame, key: str, order: str, event: str) -> DataFrame:
    """The last event of each key and how many there are, from an append-only log."""
    return log.groupBy(key).agg(F.max_by(event, order).alias(event), F.count("*").alias("events"))


def replayed(journal: DataFrame, queue: DataFrame, key: str) -> DataFrame:
    """Journal rows whose key the queue lacks: what a restart still has to append."""
    return journal.join(queue.select(key), key, "left_anti").dropDuplicates([key])


def adaptive_kl(rows: DataFrame, group: str, order: str, kl: str, start: float, target: float, horizon: float, batch: int) -> DataFrame:
    """The KL coefficient after each group's steps: times 1 + clip(kl / target - 1, 0.2) * batch / horizon each step.

    A fold over the factors, so their logarithms are summed.
    """
    error = F.greatest(F.least(F.col(kl) / target - 1, F.lit(0.2)), F.lit(-0.2))
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("coefficient", start * F.exp(F.sum(F.log1p(error * batch / horizon)).over(w)))


def turn_states(rows: DataFrame, keys: list[str], order: list[str], is_user: Column, failed: Column, most: int) -> DataFrame:
    """Adds turn (user messages so far), step in the turn, failures in the turn so far, and whether it must quit."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    turned = rows.withColumn("_turn", F.sum(is_user.cast("long")).over(w))
    inside = Window.partitionBy(*keys, "_turn").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    failures = F.sum(failed.cast("long")).over(inside)
    return turned.withColumns({"step": F.row_number().over(inside), "failures": failures, "must_quit": failures >= most}).withColumnRenamed("_turn", "turn")


def batches_until(rows: DataFrame, batch: str, kept: Column, target: int, most: int) -> DataFrame:
    """batch, kept, total for the batches drawn until enough rows are kept (``most`` batches at most)."""
    each = rows.groupBy(batch).agg(F.count_if(kept).alias("kept"))
    w = Window.orderBy(batch)  # a row for each batch
    placed = each.withColumns({"total": F.sum("kept").over(w), "_k": F.row_number().over(w)})
    return placed.where((F.col("total") - F.col("kept") < target) & (F.col("_k") <= most)).drop("_k")


def newest_versions(rows: DataFrame, content: str, version: str, source: str) -> DataFrame:
    """Of each content: the newest version, and all its sources in order."""
    return rows.groupBy(content).agg(F.max(version).alias(version), F.array_sort(F.collect_set(source)).alias("sources"))


def first_of_each(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("_k") <= n).drop("_k")


def first_ids(rows: DataFrame, key: str, n: int) -> DataFrame:
    """The first n distinct ids as text."""
    return rows.select(F.col(key).cast("string").alias("id")).distinct().orderBy("id").limit(n)


def exploded_outputs(rows: DataFrame, keys: list[str], outputs: str) -> DataFrame:
    """A row for each sample of a prompt, with its number."""
    return rows.select(*keys, F.posexplode(outputs).alias("sample", "output"))


def originals(rows: DataFrame, generated: DataFrame, key: str) -> DataFrame:
    """Rows whose id isn't that of an active generated row."""
    return rows.join(generated.where("active").select(key), key, "left_anti")


def within_capacity(rows: DataFrame, key: str, observed: str, declared: str) -> DataFrame:
    """key, observed, declared of those over their declared capacity, or without one."""
    return rows.where(F.col(declared).isNull() | (F.col(observed) > F.col(declared))).select(key, observed, declared)


def category_failures(calls: DataFrame, draft: str, category: str, rules: dict[str, Column]) -> DataFrame:
    """draft, category, failures: of each draft's calls, the rules (aggregates that must hold) that don't."""
    found = calls.groupBy(draft, category).agg(*[r.alias(f"_{k}") for k, r in enumerate(rules.values())])
    failed = F.filter(F.array(*[F.when(~F.coalesce(F.col(f"_{k}"), F.lit(False)), F.lit(n)) for k, n in enumerate(rules)]), lambda f: f.isNotNull())
    return found.select(draft, category, failed.alias("failures"))


def unneeded_calls(calls: DataFrame, group: str, call: str, intended: str, needs: str) -> DataFrame:
    """group, call of the calls that are neither intended nor something another call depends on."""
    used = calls.select(group, F.explode(needs).alias(call)).distinct()
    return calls.where(~F.col(intended)).select(group, call).join(used, [group, call], "left_anti")


def grounded(arguments: DataFrame, sources: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Arguments with ``grounded``: whether a source of the same draft has their value."""
    held = sources.select(*keys, value).distinct().withColumn("grounded", F.lit(True))
    return arguments.join(held, [*keys, value], "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))


def integrity(rows: DataFrame, expected: int, key: str, failed: Column) -> DataFrame:
    """One row: rows, whether all are there, none twice, and none failed."""
    return rows.agg(F.count("*").alias("rows"), (F.count("*") == expected).alias("complete"), (F.countDistinct(key) == F.count("*")).alias("unique"), (F.count_if(failed) == 0).alias("clean"))


def profile(rows: DataFrame, column: str) -> DataFrame:
    """Value counts (null is a value), with the rows of the whole table and how many values there are."""
    counts = rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("count"))
    totals = counts.agg(F.sum("count").alias("rows"), F.count("*").alias("values"))
    return counts.crossJoin(F.broadcast(totals))  # one row
