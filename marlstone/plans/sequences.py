"""Registered queries of token sequences, decoded results and merged settings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calls as C
from ..functions import protocol as P
from ..operators import gates as G
from ..operators import nested as N
from ..operators import sequences as S
from .queries import query
from .tables import table

WORDS_SQL = r"len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda x: x <> ''))"


@query(f"""SELECT conv_id, sum({WORDS_SQL} + 2)::INT AS tokens, sum(CASE WHEN role = 'assistant' THEN {WORDS_SQL} + 1 ELSE 0 END)::BIGINT AS trained FROM conversations GROUP BY 1""")
def conversation_masks(spark, sf):
    found = S.conversation_tokens(table(spark, sf, "conversations"), ["conv_id"], "turn", "role", "text")
    return found.select("conv_id", F.size("tokens").alias("tokens"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("trained"))


@query(f"""WITH n AS (SELECT conv_id, sum({WORDS_SQL} + 2)::INT AS n FROM conversations GROUP BY 1) SELECT conv_id, b::INT AS batch, least(64, n - b * 64)::INT AS size FROM n, range(100000) t(b) WHERE b * 64 < n""")
def token_batches(spark, sf):
    found = S.fixed_batches(S.conversation_tokens(table(spark, sf, "conversations"), ["conv_id"], "turn", "role", "text"), ["tokens", "mask"], 64)
    return found.select("conv_id", "batch", F.size("mask").alias("size"))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '{"order":' || o_orderkey || ',"by":[' || o_custkey || ',"' || o_orderstatus || '"]}' WHEN 1 THEN '{"inner":{"k":' || o_custkey || ',"none":null}}' ELSE '"order ' || o_orderkey || '"' END AS value FROM orders""")
def decoded_results(spark, sf):
    key, by = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("{'order': "), key, F.lit(", 'by': ("), by, F.lit(", '"), "o_orderstatus", F.lit("')}"))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit('{"inner": "{\'k\': '), by, F.lit(', \'none\': None}"}'))).otherwise(F.concat(F.lit("order "), key))
    return table(spark, sf, "orders").select("o_orderkey", N.decoded(text).alias("value"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 1 THEN '{"at":{"by":' || CASE o_orderkey % 4 WHEN 0 THEN o_custkey ELSE o_orderkey END || ',"state":"' || o_orderstatus || '"},"n":1' || CASE o_orderkey % 4 WHEN 2 THEN ',"new":null' ELSE '' END || '}' END AS value, o_orderkey % 4 = 1 AS failed FROM orders""")
def merged_settings(spark, sf):
    base = F.to_json(F.struct(F.struct(F.col("o_custkey").alias("by"), F.col("o_orderstatus").alias("state")).alias("at"), F.lit(1).alias("n")))
    own = F.concat(F.lit('{"at": {"by": '), F.col("o_orderkey").cast("string"), F.lit("}"))
    patch = F.when(F.col("o_orderkey") % 4 == 0, "{}").when(F.col("o_orderkey") % 4 == 1, '{"at": {"by": "text"}}').when(F.col("o_orderkey") % 4 == 2, F.concat(own, F.lit(', "new": null}'))).otherwise(F.concat(own, F.lit("}")))
    found = table(spark, sf, "orders").select("o_orderkey", N.merged(base, patch).alias("m"))
    return found.select("o_orderkey", "m.value", F.col("m.error").isNotNull().alias("failed"))


@query("""WITH l AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber) AS i FROM lineitem) SELECT l_orderkey, 'buy' AS name, '{"part": ' || min_by(l_partkey, i) || ', "note": "x"}' AS arguments FROM l WHERE l_partkey % 3 = 0 GROUP BY 1""")
def first_gold_calls(spark, sf):
    part = F.col("l_partkey").cast("string")
    text = F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("buy(part="), part, F.lit(", note='x')"))).when(F.col("l_partkey") % 3 == 1, F.concat(F.lit("find("), part, F.lit(")"))).otherwise(F.concat(F.lit("shop.buy(part="), part, F.lit(")")))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", text.alias("text"))
    return C.first_keyword_calls(rows, ["l_orderkey"], ["l_partkey", "l_suppkey", "l_linenumber"], "text").drop("source")


@query("""WITH m AS (SELECT o_orderkey, o_orderkey % 5 AS w, o_orderkey % 3 AS t FROM orders) SELECT o_orderkey, (w < 3)::INT AS valid_tool_call_block, (w < 3)::INT AS json_parse_ok, (w < 3 AND t < 2)::INT AS function_name_ok, (w < 2)::INT AS arguments_object_ok,
(w < 3 AND (t > 0 OR w = 0))::INT AS required_arguments_ok, (w = 3)::INT AS direct_answer_without_tool, (w = 4)::INT AS malformed_output FROM m""")
def action_metrics(spark, sf):
    way, key = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    name = F.element_at(F.array(F.lit("find"), F.lit("list"), F.lit("guess")), (F.col("o_orderkey") % 3).cast("int") + 1)
    given = F.when(way == 0, F.concat(F.lit('{"id": '), key, F.lit("}"))).when(way == 1, F.lit('{"other": 1}')).otherwise(F.lit("[1]"))
    call = F.concat(F.lit('<think>so</think><tool_call>[{"name": "'), name, F.lit('", "arguments": '), given, F.lit("}]</tool_call>"))
    text = F.when(way < 3, call).when(way == 3, F.concat(F.lit("<think>so</think><answer>"), key, F.lit("</answer>"))).otherwise(F.concat(call, F.lit(" more")))
    tools = F.array(F.struct(F.lit("find").alias("name"), F.array(F.lit("id")).alias("required")), F.struct(F.lit("list").alias("name"), F.array().cast("array<string>").alias("required")))
    return table(spark, sf, "orders").select("o_orderkey", P.action_metrics(text, tools).alias("m")).select("o_orderkey", "m.*")


@query("""SELECT conv_id, CASE WHEN turn % 2 = 0 THEN '[{"name":"f' || turn || '","n":' || turn || '}]' END AS tools, turn FROM conversations WHERE turn % 2 = 0 OR turn % 5 = 1""")
def restored_tools(spark, sf):
    turn = F.col("turn").cast("string")
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit('[{"name": "f'), turn, F.lit('", "n": '), turn, F.lit("}] "), F.lit(P.RESTORED), F.lit(". "), F.col("text"))).when(F.col("turn") % 5 == 1, F.concat(F.col("text"), F.lit(P.RESTORED))).otherwise(F.col("text"))
    return table(spark, sf, "conversations").select("conv_id", "turn", P.restored_tools(text).alias("r")).where("r IS NOT NULL").select("conv_id", "turn", "r.tools")


@query("""WITH c AS (SELECT conv_id, list(text ORDER BY turn, text) AS whole, list(text ORDER BY turn, text) FILTER (turn > 0) AS part FROM conversations GROUP BY 1)
SELECT conv_id % 3 AS category, count(*) AS records, 0::BIGINT AS exact, count(*) FILTER (conv_id % 2 = 0 OR len(part) = 1) AS kept FROM c WHERE part IS NOT NULL GROUP BY 1""")
def preserved_turns(spark, sf):
    said = F.array_sort(F.collect_list(F.struct("turn", "text")))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(said.alias("s"))
    rows = rows.select((F.col("conv_id") % 3).alias("category"), "conv_id", F.col("s.text").alias("whole"), F.transform(F.filter("s", lambda x: x["turn"] > 0), lambda x: x["text"]).alias("part")).where(F.size("part") > 0)
    return G.preservation_audit(rows.withColumn("part", F.when(F.col("conv_id") % 2 == 0, F.col("part")).otherwise(F.reverse("part"))), "category", "part", "whole")
