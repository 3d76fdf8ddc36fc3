"""The driver's tables in the roles that rollouts, steps and codes have."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rollouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """uid (prompt group), rollout, score, category."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("uid"), F.col("o_orderkey").alias("rollout"), F.col("o_totalprice").alias("score"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("at"))


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rollout, depth, reward, length: lines numbered from 0 within an order."""
    from pyspark.sql import Window

    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    depth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("rollout"), depth.alias("depth"), F.col("l_discount").alias("reward"), F.col("l_quantity").alias("length"), F.col("l_returnflag").alias("flag"))


STEPS_SQL = """steps AS (SELECT l_orderkey AS rollout, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) - 1 AS depth,
  l_discount AS reward, l_quantity AS length, l_returnflag AS flag FROM lineitem)"""

#: Diagnostic codes of the event types.
CODES = {"error": -3, "click": -2, "view": -1, "signup": 0, "purchase": 1}


def coded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_id, ts, value, code, day."""
    code = F.lit(None).cast("int")
    for kind, n in CODES.items():
        code = F.when(F.col("event_type") == kind, n).otherwise(code)
    return table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value", "event_type", code.alias("code"), F.to_date("ts").alias("day"))


CODES_SQL = "coded AS (SELECT user_id, event_id, ts, value, event_type, CASE event_type WHEN 'error' THEN -3 WHEN 'click' THEN -2 WHEN 'view' THEN -1 WHEN 'signup' THEN 0 WHEN 'purchase' THEN 1 END AS code, CAST(ts AS DATE) AS day FROM events)"
