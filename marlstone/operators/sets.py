"""Sets of records: disjoint and complete splits, content identities, duplicates with pointers, exactly-once appends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_id(prefix: str, *columns: Column) -> Column:
    """A stable identity: the prefix and the first 24 hex digits of the SHA-256 of the columns' JSON, fields sorted by name."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(F.to_json(F.struct(*sorted(columns, key=str))), 256), 1, 24))


def duplicates_routed(rows: DataFrame, key: list[str], order: list[str], id_col: str) -> DataFrame:
    """All rows, with ``duplicate_of``: the first row of the same key, null for that row itself."""
    first = rows.groupBy(*key).agg(F.min(F.struct(*order, F.col(id_col).alias("_id")))["_id"].alias("_first"))
    joined = rows.join(first, key)
    return joined.withColumn("duplicate_of", F.when(F.col(id_col) != F.col("_first"), F.col("_first"))).drop("_first")


def split_check(whole: DataFrame, parts: dict[str, DataFrame], key: str) -> DataFrame:
    """key, n_parts, ok: whether each key of the whole lies in exactly one part, and parts hold nothing else."""
    tagged = None
    for name, part in parts.items():
        one = part.select(key).distinct().withColumn("_part", F.lit(name))
        tagged = one if tagged is None else tagged.unionByName(one)
    counted = tagged.groupBy(key).agg(F.count("*").alias("n_parts"))
    both = whole.select(key).distinct().withColumn("_w", F.lit(1)).join(counted, key, "full_outer")
    return both.select(key, F.coalesce("n_parts", F.lit(0)).alias("n_parts"), (F.col("_w").isNotNull() & (F.col("n_parts") == 1)).alias("ok")).withColumn("ok", F.coalesce("ok", F.lit(False)))


def appended_once(held: DataFrame, new: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """New rows to append: known keys with the same fingerprint are skipped, with another one it raises; repeats in ``new`` count once."""
    known = held.select(key, F.col(fingerprint).alias("_known")).distinct()
    fresh = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(fingerprint))).withColumn("_kinds", F.size(F.collect_set(fingerprint).over(Window.partitionBy(key))))
    fresh = fresh.where(F.when(F.col("_kinds") > 1, F.raise_error(F.lit("conflicting new rows"))).otherwise(F.col("_n") == 1)).drop("_n", "_kinds")
    joined = fresh.join(known, key, "left")
    return joined.where(F.when(F.col("_known").isNull(), True).when(F.col("_known") == F.col(fingerprint), False).otherwise(F.raise_error(F.lit("conflicting key")))).drop("_known")


def multiset_difference(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """column, n_a, n_b of the values whose counts differ."""
    x, y = a.groupBy(column).agg(F.count("*").alias("n_a")), b.groupBy(column).agg(F.count("*").alias("n_b"))
    return x.join(y, column, "full_outer").select(column, F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b")).where("n_a != n_b")
