"""Rows: selection by position, repetition, chunks, windows over runs, and reports of their parts."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held(rows: DataFrame) -> DataFrame:
    """Rows written to the checkpoint folder, whose partitions stay as they are; one of its own where none is set and all runs in one process."""
    context = rows.sparkSession.sparkContext
    if not context.getCheckpointDir():
        shared = rows.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and context.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="marlstone-"))
    return rows.checkpoint()


def numbered(rows: DataFrame, order: list[str], out: str = "row_id") -> DataFrame:
    """Adds row numbers from 0 in a global order: rows are dealt by range and sorted, then numbered within partitions.

    Only a row count for each partition goes through a window without keys.
    """
    sorted_rows = held(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    placed = sorted_rows.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_start"))
    return placed.join(F.broadcast(starts), "_part").withColumn(out, (F.col("_start") + F.col("_pos")).cast("long")).drop("_part", "_pos", "_start")  # a row for each partition


def at_positions(rows: DataFrame, row: str, positions: list[int]) -> DataFrame:
    """The rows at positions, in that order and as often as they are listed."""
    wanted = rows.sparkSession.createDataFrame(list(enumerate(positions)), f"pos int, {row} int")
    return F.broadcast(wanted).join(rows, row).orderBy("pos")


def every(rows: DataFrame, row: str, start: int, stop: int, step: int = 1) -> DataFrame:
    """A positional slice."""
    return rows.where((F.col(row) >= start) & (F.col(row) < stop) & ((F.col(row) - start) % step == 0))


def repeated(rows: DataFrame, times: Column | int, out: str = "rep") -> DataFrame:
    """Each row as often as ``times`` says, with the number of the repeat."""
    n = F.lit(times) if isinstance(times, int) else times
    return rows.where(n > 0).withColumn(out, F.explode(F.sequence(F.lit(0), n - 1)))


def padded(rows: DataFrame, row: str, size: int) -> DataFrame:
    """Rows up to a multiple of ``size``, the first ones repeated at the end with numbers of their own."""
    n = rows.agg(F.count("*").alias("_n"))
    extra = rows.join(F.broadcast(n)).where(F.col(row) < F.pmod(-F.col("_n"), F.lit(size))).withColumn(row, F.col(row) + F.col("_n")).drop("_n")
    return rows.unionByName(extra)


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str, out: str = "run") -> DataFrame:
    """Adds the number of the run of equal values that a row is in."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn(out, F.sum((~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def recoveries(rows: DataFrame, keys: list[str], order: str, failed: Column) -> DataFrame:
    """keys of groups with a failure, recovered (a success after the first) and strict (after the last)."""
    success = F.max(F.when(~failed, F.col(order)))
    return rows.groupBy(*keys).agg(F.min(F.when(failed, F.col(order))).alias("_first"), F.max(F.when(failed, F.col(order))).alias("_last"), success.alias("_ok")).where("_first IS NOT NULL").select(*keys, F.coalesce(F.col("_ok") > F.col("_first"), F.lit(False)).alias("recovered"), F.coalesce(F.col("_ok") > F.col("_last"), F.lit(False)).alias("strict"))


def attempts(rows: DataFrame, keys: list[str], order: list[str], is_call: Column) -> DataFrame:
    """Adds step (from 0) and call (number of calls so far less one, null on other steps)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("step", F.row_number().over(w) - 1).withColumn("call", F.when(is_call, F.sum(is_call.cast("int")).over(upto) - 1))


def last_mean(rows: DataFrame, order: list[str], value: str, n: int = 5) -> DataFrame:
    """mean of the last n rows."""
    return rows.orderBy(*[F.desc(o) for o in order]).limit(n).agg(F.avg(value).alias("mean"))


def micro_macro(rows: DataFrame, category: str, right: Column) -> DataFrame:
    """micro: the rate over all rows; macro: the mean of the categories' rates."""
    by = rows.groupBy(category).agg(F.avg(right.cast("double")).alias("_rate"), F.count("*").alias("_n"))
    return by.agg((F.sum(F.col("_rate") * F.col("_n")) / F.sum("_n")).alias("micro"), F.avg("_rate").alias("macro"))


def band(rows: DataFrame, keys: list[str], score: str, low: float, high: float) -> DataFrame:
    """Rows of groups whose mean score lies in the closed band."""
    return rows.withColumn("_m", F.avg(score).over(Window.partitionBy(*keys))).where(F.col("_m").between(low, high)).drop("_m")


def chained(rows: DataFrame, keys: list[str], order: list[str], before: str, after: str) -> DataFrame:
    """Adds ``linked``: whether the previous row ended in the state that this one begins with; null at the first."""
    return rows.withColumn("linked", F.lag(after).over(Window.partitionBy(*keys).orderBy(*order)) == F.col(before))


def running_set(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Adds ``known`` (distinct values so far, sorted) and ``fresh`` (whether this one is new)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("known", F.array_sort(F.array_distinct(F.collect_list(value).over(w.rowsBetween(Window.unboundedPreceding, 0))))).withColumn("fresh", ~F.array_contains(F.coalesce(F.collect_list(value).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.array()), F.col(value)))


def common_classes(rows: DataFrame, key: str, classes: str) -> DataFrame:
    """key, common (classes that all of the key's rows have) and unique (whether there is exactly one)."""
    per = rows.select(key, F.explode(F.array_distinct(classes)).alias("c")).groupBy(key, "c").agg(F.count("*").alias("_n"))
    all_of = rows.groupBy(key).agg(F.count("*").alias("_all"))
    found = per.join(all_of, key).where("_n = _all").groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("common"))
    return all_of.select(key).join(found, key, "left").withColumn("common", F.coalesce("common", F.expr("cast(array() as array<string>)"))).withColumn("unique", F.size("common") == 1)


#: Words of queries (each query's own) that are broadcast; more are joined by shuffles.
ASKED = 200_000


def lexical_search(docs: DataFrame, queries: DataFrame, doc: str, query: str, text: str, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query, doc, score, rank: BM25 over an inverted index of lower-case words.

    A document is read once, into the number of its words (as the empty word) and the times of those that queries
    have; nothing else is shuffled. Everything of a document lies in one partition when its words meet the queries,
    which are few beside documents, so that scores are summed where they arise.
    """
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    asked = held(queries.select(query, F.explode(words).alias("word")).distinct())
    few = F.broadcast if asked.count() <= ASKED else lambda rows: rows  # what is broadcast has a bound
    counted = docs.select(doc, words.alias("_w")).select(doc, F.size("_w").cast("long").alias("_n"), F.explode(F.array_append("_w", F.lit(""))).alias("word"))
    wanted = asked.select("word").distinct().unionByName(asked.sparkSession.createDataFrame([("",)], "word string"))
    terms = held(counted.join(few(wanted), "word", "left_semi").groupBy("word", doc).agg(F.sum(F.when(F.col("word") == "", F.col("_n")).otherwise(1)).alias("tf")).where("tf > 0"))
    length = terms.where("word = ''").select(doc, F.col("tf").alias("dl"))
    total = length.agg(F.count("*").alias("n"), F.avg("dl").alias("mean"))
    found = terms.where("word != ''")
    df = found.groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    postings = asked.join(df, "word").join(F.broadcast(total)).select(query, "word", idf.alias("idf"), "mean")
    own = found.repartition(doc).join(length.repartition(doc), doc)
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("mean")))
    scored = own.join(few(postings), "word").groupBy(query, doc).agg(F.round(F.sum(part), 6).alias("score"))
    best = Window.partitionBy(query).orderBy(F.desc("score"), doc)
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
