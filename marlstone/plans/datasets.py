"""Registered queries of training files: what the tables hold in the roles of prompts, labels and recorded responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import datasets as D
from .queries import query
from .tables import table


@query(r"""SELECT doc_id FROM documents WHERE len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> '')) <= 150""")
def prompts_within_length(spark, sf):
    return D.within_length(table(spark, sf, "documents"), F.col("text"), 150).select("doc_id")


@query("""SELECT o_orderkey, 'who is ' || o_custkey AS prompt, o_orderstatus AS response FROM orders""")
def nested_prompt_responses(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.struct(F.struct(F.concat(F.lit("who is "), F.col("o_custkey").cast("string")).alias("text")).alias("question")).alias("prompt"), F.create_map(F.lit("final"), F.col("o_orderstatus"), F.lit("draft"), F.lit("?")).alias("response"))
    return rows.select("o_orderkey", D.inner("prompt", ["question", "text"]).alias("prompt"), D.inner("response", ["final"]).alias("response"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'nobody' END AS role, r.text FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey % 3 ORDER BY c_custkey) AS n FROM customer) c
LEFT JOIN (SELECT role, text, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn, text) AS n FROM conversations) r ON r.n = c.n AND r.role = CASE c_custkey % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' END""")
def replayed_responses(spark, sf):
    role = F.when(F.col("c_custkey") % 3 == 0, "user").when(F.col("c_custkey") % 3 == 1, "assistant").otherwise("nobody")
    asked = table(spark, sf, "customer").select("c_custkey", role.alias("role"))
    given = table(spark, sf, "conversations").withColumn("said", F.col("text"))
    return D.replayed(asked, given, "role", ["c_custkey"], ["conv_id", "turn", "said"]).select("c_custkey", "role", "text")


@query("""SELECT coalesce(a.k, '') AS key, coalesce(a.v, '') AS customer, coalesce(a.w, '') AS supplier FROM (SELECT c_custkey::VARCHAR AS k, c_name AS v, NULL AS w FROM customer UNION ALL SELECT s_suppkey::VARCHAR, NULL, s_name FROM supplier) a""")
def united_by_keys(spark, sf):
    parts = [table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("customer")), table(spark, sf, "supplier").select(F.col("s_name").alias("supplier"), F.col("s_suppkey").alias("key"))]
    return D.united_by_keys(parts)
