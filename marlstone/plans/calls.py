"""Registered queries of call texts and turn checks: lines of orders are calls, orders are turns of a customer."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import calls as C
from ..operators import checkers as K
from .queries import query
from .tables import STEPS_SQL, rollouts, steps, table

CALLS_SQL = STEPS_SQL.replace("l_discount AS reward", "l_partkey AS part, l_suppkey AS supplier, l_discount AS reward") + ", calls AS (SELECT *, CASE WHEN part % 4 = 0 THEN 'plain' WHEN part % 4 = 1 THEN 'nested' WHEN part % 4 = 2 THEN 'listed' ELSE 'broken' END AS form FROM steps)"


def call_texts(spark, sf):
    """rollout, depth, text: a plain call, one of a nested call, one of calls in containers, or an unreadable one."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    depth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)) - 1
    part, supplier = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    text = (
        F.when(F.col("l_partkey") % 4 == 0, F.concat(F.lit("shop.buy(part="), part, F.lit(", note='x y', back=-"), supplier, F.lit(", gift=True)")))
        .when(F.col("l_partkey") % 4 == 1, F.concat(F.lit("send(what=find(part="), part, F.lit(", where=locate(supplier="), supplier, F.lit(")), times=2*3)")))
        .when(F.col("l_partkey") % 4 == 2, F.concat(F.lit("pack(items=[find(part="), part, F.lit("), 'box'], tag={'k': None})")))
        .otherwise(F.concat(F.lit("broken("), part))
    )
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rollout"), depth.alias("depth"), text.alias("text"))


@query(f"""WITH {CALLS_SQL} SELECT rollout, CAST(row_number() OVER (PARTITION BY rollout ORDER BY depth) - 1 AS INTEGER) AS call_idx, CASE form WHEN 'plain' THEN 'shop.buy' WHEN 'nested' THEN 'send' WHEN 'listed' THEN 'pack' END AS name,
CASE form WHEN 'plain' THEN '{{"part": ' || part || ', "note": "x y", "back": ' || (-supplier) || ', "gift": true}}' WHEN 'nested' THEN '{{"what": {{"find": {{"part": ' || part || ', "where": {{"locate": {{"supplier": ' || supplier || '}}}}}}}}, "times": 6}}'
  WHEN 'listed' THEN '{{"items": [{{"find": {{"part": ' || part || '}}}}, "box"], "tag": {{"k": null}}}}' END AS arguments, form <> 'broken' AS valid FROM calls""")
def canonical_call_texts(spark, sf):
    return C.canonical_calls(call_texts(spark, sf), ["rollout"], "depth", "text").drop("error")


@query(f"""WITH {CALLS_SQL} SELECT rollout, depth AS line, unnest(CASE form WHEN 'nested' THEN ['find', 'locate'] WHEN 'listed' THEN ['find'] ELSE [] END) AS producer, unnest(CASE form WHEN 'nested' THEN ['send', 'find'] WHEN 'listed' THEN ['pack'] ELSE [] END) AS consumer FROM calls""")
def nested_call_edges(spark, sf):
    found = C.with_calls(call_texts(spark, sf).withColumnRenamed("depth", "line"), "text")
    return found.where("kind = 'edge'").select("rollout", "line", F.col("name").alias("producer"), "consumer")


@query(f"""WITH {CALLS_SQL}, t AS (SELECT rollout, depth // 2 AS turn, count(*) AS n, coalesce(list_sort(list(DISTINCT CASE form WHEN 'plain' THEN 'Shop' WHEN 'nested' THEN 'Post' WHEN 'listed' THEN 'Post' END) FILTER (form <> 'broken')), []) AS c FROM calls GROUP BY 1, 2),
u AS (SELECT * FROM t UNION ALL SELECT rollout, max(turn) + 1, 0, [] FROM t GROUP BY rollout), e AS (SELECT rollout, CAST(sum(CASE form WHEN 'nested' THEN 2 WHEN 'listed' THEN 1 ELSE 0 END) AS INTEGER) AS edges, max(CASE form WHEN 'nested' THEN 3 WHEN 'listed' THEN 2 WHEN 'plain' THEN 1 ELSE 0 END) AS depth, count(*) FILTER (form = 'broken') AS unreadable FROM calls GROUP BY 1)
SELECT rollout, CAST(count(*) AS INTEGER) AS turns, list(n ORDER BY turn) AS calls_per_turn, array_to_string(list(array_to_string(c, '+') ORDER BY turn), ',') AS classes, any_value(edges) AS edges, any_value(depth) AS depth, any_value(unreadable) AS unreadable FROM u JOIN e USING (rollout) GROUP BY 1""")
def seed_profiles(spark, sf):
    calls = call_texts(spark, sf).withColumn("turn", F.floor(F.col("depth") / 2)).withColumnRenamed("depth", "nth")
    turns = calls.select("rollout", "turn").unionByName(calls.groupBy("rollout").agg((F.max("turn") + 1).alias("turn")))
    catalog = spark.createDataFrame([("shop.buy", "Shop"), ("send", "Post"), ("pack", "Post")], "name string, class string")
    found = C.structural_profile(turns, calls, catalog, "rollout", "turn", "nth", "text")
    return found.select("rollout", "turns", "calls_per_turn", F.array_join(F.transform("classes_per_turn", lambda c: F.array_join(c, "+")), ",").alias("classes"), F.size("edges").alias("edges"), "depth", "unreadable")


TURNS_SQL = f"""{STEPS_SQL}, turns AS (SELECT o_orderkey AS rollout, o_custkey AS uid, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS turn, o_orderkey % 19 = 0 AS changed, o_orderstatus AS class FROM orders),
lines AS (SELECT uid, turn, CAST(length AS BIGINT) % 5 AS v, reward >= 0.02 AND flag <> 'R' OR length % 4 > 0 AS told, turn % 6 <> 5 AS asked FROM steps JOIN turns USING (rollout)),
b AS (SELECT uid, v, turn, count(*) FILTER (told) AS m, count(*) FILTER (asked AND v > 1) AS g FROM lines GROUP BY 1, 2, 3), r AS (SELECT *, g - sum(m) OVER (PARTITION BY uid, v ORDER BY turn) AS lack FROM b),
missing AS (SELECT uid, turn, v, CAST(lack AS BIGINT) AS missing FROM r WHERE g > 0 AND lack > 0),
counted AS (SELECT t.uid, t.turn, any_value(changed) AS changed, any_value(class) AS class, count(l.v) FILTER (asked AND v > 1) AS gold, count(l.v) FILTER (told) AS model FROM turns t LEFT JOIN lines l USING (uid, turn) GROUP BY 1, 2)"""


def turn_tables(spark, sf):
    """(turns, model results, expected results, model states, expected states) of customers' orders."""
    at = (F.row_number().over(Window.partitionBy("uid").orderBy("rollout")) - 1).alias("turn")
    turns = rollouts(spark, sf).select("rollout", "uid", at, (F.col("rollout") % 19 == 0).alias("changed"), F.col("status").alias("class"))
    told = (F.col("reward") >= 0.02) & (F.col("flag") != "R") | (F.col("length") % 4 > 0)
    lines = steps(spark, sf).join(turns, "rollout").select("uid", "turn", (F.col("length").cast("long") % 5).alias("v"), told.alias("told"), ((F.col("turn") % 6 != 5) & (F.col("length").cast("long") % 5 > 1)).alias("asked"))
    counts = turns.select("uid", "turn").join(lines.groupBy("uid", "turn").agg(F.count_if("asked").alias("gold_calls"), F.count_if("told").alias("model_calls")), ["uid", "turn"], "left").fillna(0)
    state = lambda value: turns.select("uid", "turn", "class", F.ascii("class").alias("place"), F.lit("sum").alias("attribute"), value.alias("value"))
    return counts, lines.where("told"), lines.where("asked"), state(F.when(F.col("changed"), -1).otherwise(F.col("rollout"))), state(F.col("rollout"))


@query(f"""WITH {TURNS_SQL} SELECT uid, turn, v, missing FROM missing""")
def missing_responses(spark, sf):
    _, model, gold, _, _ = turn_tables(spark, sf)
    return K.missing_responses(model, gold, ["uid"], "turn", "v")


@query(f"""WITH {TURNS_SQL}, e AS (SELECT uid, turn, CASE WHEN gold = 0 THEN NULL WHEN model = 0 THEN 'empty_response' WHEN changed THEN 'state_mismatch' WHEN EXISTS (SELECT 1 FROM missing m WHERE m.uid = c.uid AND m.turn = c.turn) THEN 'response_mismatch' END AS error, class FROM counted c)
SELECT uid, count(error) = 0 AS valid, min(turn) FILTER (error IS NOT NULL) AS turn, min_by(error, turn) FILTER (error IS NOT NULL) AS error, min_by(CASE WHEN error = 'state_mismatch' THEN class ELSE '' END, turn) FILTER (error IS NOT NULL) AS subject FROM e GROUP BY 1""")
def turn_checks(spark, sf):
    turns, model, gold, own, wanted = turn_tables(spark, sf)
    found = K.checked_turns(turns, K.state_mismatches(own, wanted, ["uid", "turn"]), K.missing_responses(model, gold, ["uid"], "turn", "v"), ["uid"])
    return found.withColumn("subject", F.when(F.col("error").isNotNull(), F.coalesce("subject", F.lit(""))))


@query(f"""WITH {TURNS_SQL} SELECT uid, min(turn) AS turn FROM counted WHERE gold = 0 AND model > 0 GROUP BY 1""")
def idle_turns(spark, sf):
    return K.idle_turn_failures(turn_tables(spark, sf)[0], ["uid"])


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN CASE WHEN user_id % 7 + 1 > 5 THEN CASE WHEN user_id % 3 = 0 THEN 0.0 ELSE value END ELSE -3.0 END WHEN user_id % 3 = 0 THEN CASE event_type WHEN 'view' THEN 1.0 WHEN 'click' THEN 0.0 END END::DOUBLE AS score FROM events""")
def forced_scores(spark, sf):
    kind = F.when(F.col("event_type") == "error", "parse_error").when(F.col("event_type") == "view", "answer").when(F.col("event_type") == "click", "tool_call").otherwise("other")
    return table(spark, sf, "events").select("event_id", K.forced_score(F.col("user_id") % 3, kind, F.col("user_id") % 7, 5, F.col("value")).alias("score"))
