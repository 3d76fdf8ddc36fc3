"""Registered queries of training rows: parts are questions whose prices are answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import builders as B
from .queries import query
from .tables import table


@query("""SELECT CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS BIGINT) AS index, 'parts' AS data_source, p_name || ' Let''s think step by step and output the final answer after "####".' AS content, CAST(p_size AS VARCHAR) || p_partkey AS truth FROM part""")
def question_rows(spark, sf):
    answer = F.concat(F.lit("it is #### "), F.col("p_size").cast("string"), F.lit(","), F.col("p_partkey").cast("string"))
    rows = table(spark, sf, "part").withColumn("answer", answer)
    out = B.training_rows(rows, ["p_partkey"], "parts", F.col("p_name"), B.marked_solution(F.col("answer")), "math", "train", instruction=B.STEP_BY_STEP)
    return out.select("extra_info.index", "data_source", F.col("prompt")[0]["content"].alias("content"), F.col("reward_model.ground_truth").alias("truth"))


@query("""SELECT o_orderkey, unnest([o_orderstatus, o_orderpriority]) AS response FROM orders""")
def supervised_rows(spark, sf):
    pairs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("prompt"), F.col("o_orderstatus").alias("chosen"), F.col("o_orderpriority").alias("rejected"))
    return B.supervised_rows(pairs).withColumnRenamed("prompt", "o_orderkey")


@query("""SELECT 'rows' AS "column", NULL::VARCHAR AS value, count(*) AS rows FROM documents UNION ALL SELECT 'ids', NULL, count(DISTINCT doc_id) FROM documents UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2""")
def table_profile(spark, sf):
    rows = table(spark, sf, "documents")
    return B.profile(rows, ["lang", "source"], [rows["doc_id"]])


@query("""SELECT (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)) AS accepted, count(*) - (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)) AS duplicates FROM lineitem""")
def append_counts(spark, sf):
    held = table(spark, sf, "part").where("p_size < 25").select(F.col("p_partkey").alias("k"))
    return B.appended(held, table(spark, sf, "lineitem").select(F.col("l_partkey").alias("k")), "k")[1]
