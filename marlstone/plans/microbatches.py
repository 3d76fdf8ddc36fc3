"""Registered queries of micro-batches: customers by twenty are batches, their orders sequences of four ranks; the SQL states counts and bounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import microbatches as M
from .queries import query
from .tables import table

CAP = 4000
ITEMS_SQL = "items AS (SELECT o_custkey // 20 AS batch, o_orderkey % 4 AS rank, o_orderkey AS item, o_orderkey % 500 + 1 AS n FROM orders)"
SHARES_SQL = ITEMS_SQL + f", shares AS (SELECT batch, rank, count(*) AS items, CAST(sum(n) AS BIGINT) AS total, max(n) AS longest, least(count(*), CAST(ceil(sum(n) / {CAP}) AS BIGINT)) AS own FROM items GROUP BY 1, 2)"


def sequences(spark, sf):
    return table(spark, sf, "orders").select(F.floor(F.col("o_custkey") / 20).alias("batch"), (F.col("o_orderkey") % 4).alias("rank"), F.col("o_orderkey").alias("item"), (F.col("o_orderkey") % 500 + 1).alias("n"))


def shares(parts, spark, sf):
    """batch, rank, part, items, load of parts."""
    return parts.join(sequences(spark, sf).select("item", "n"), "item").groupBy("batch", "rank", "part").agg(F.count("*").alias("items"), F.sum("n").alias("load"))


@query(f"""WITH {SHARES_SQL} SELECT batch, rank, items, total, CAST(2 * ceil(max(own) OVER (PARTITION BY batch) / 2) AS INTEGER) AS parts FROM shares""")
def micro_batch_counts(spark, sf):
    return M.micro_counts(sequences(spark, sf), ["batch"], "rank", "n", CAP, multiple=2).drop("longest")


@query(f"""WITH {SHARES_SQL} SELECT batch, rank, items, total, max(own) OVER (PARTITION BY batch) AS parts, true AS alike FROM shares""")
def micro_batches_by_rank(spark, sf):
    found = shares(M.micro_batches(sequences(spark, sf), ["batch"], "rank", "item", "n", CAP), spark, sf)
    out = found.groupBy("batch", "rank").agg(F.sum("items").alias("items"), F.sum("load").alias("total"), F.count("*").alias("parts"), F.max("load").alias("_hi"), F.min("load").alias("_lo"))
    return out.withColumn("alike", F.col("_hi") - F.col("_lo") <= 500).drop("_hi", "_lo")  # the longest item


@query(f"""WITH {SHARES_SQL} SELECT batch, sum(items)::BIGINT AS items, sum(total)::BIGINT AS total, 0::BIGINT AS overfull, true AS alike, true AS enough FROM shares GROUP BY 1""")
def strict_micro_batches(spark, sf):
    found = shares(M.strict_micro_batches(sequences(spark, sf), ["batch"], "rank", "item", "n", CAP, multiple=3, least=1), spark, sf)
    by_rank = found.groupBy("batch", "rank").agg(F.sum("items").alias("items"), F.sum("load").alias("total"), F.count("*").alias("parts"), F.count_if(F.col("load") > CAP).alias("over"))
    return by_rank.groupBy("batch").agg(F.sum("items").alias("items"), F.sum("total").alias("total"), F.sum("over").alias("overfull"), ((F.min("parts") == F.max("parts")) & (F.max("parts") % 3 == 0)).alias("alike"), F.min(F.col("parts") >= F.ceil(F.col("total") / CAP)).alias("enough"))


@query(f"""WITH {ITEMS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY item) AS i, count(*) OVER (PARTITION BY batch) AS c FROM items), w AS (SELECT * FROM k WHERE i <= c - c % 8)
SELECT batch, r AS rank, count(*) // 8 AS items, CAST(r * (count(*) // 8) AS INTEGER) AS first, CAST((r + 1) * (count(*) // 8) - 1 AS INTEGER) AS last, true AS alike FROM w, range(8) t(r) GROUP BY batch, r""")
def ranks_of_like_totals(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("batch")
    rows = sequences(spark, sf).withColumn("_i", F.row_number().over(w.orderBy("item"))).withColumn("_c", F.count("*").over(w)).where("_i <= _c - _c % 8").drop("_i", "_c")
    order = M.balanced_order(rows, ["batch"], "item", "n", 8).join(rows.select("item", "n"), "item")
    by_rank = order.groupBy("batch", "rank").agg(F.count("*").alias("items"), F.min("position").alias("first"), F.max("position").alias("last"), F.sum("n").alias("_load"))
    spread = F.max("_load").over(w) - F.min("_load").over(w)
    return by_rank.withColumn("alike", spread <= 500).drop("_load").withColumn("rank", F.col("rank").cast("long"))
