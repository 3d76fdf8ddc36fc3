"""Registered queries of nested values: each order is a JSON text of its lines; the SQL reads the tables themselves."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import nested as N
from .queries import query
from .tables import STEPS_SQL, rollouts, table

LINES_SQL = STEPS_SQL.replace("l_discount AS reward", "l_partkey AS part, CAST(round(l_extendedprice * 100) AS BIGINT) AS price, l_discount AS reward")


#: Levels of what order_values makes, by its types: an object, in it an array, in it objects.
LEVELS = 3


def order_values(spark, sf):
    """rollout, doc: {"order_id", "placed": {"by", "status"}, "lines": [{"part_no", "price", "note"}]}; returned lines have a note that is an error."""
    return values_with_first(spark, sf).drop("first")


def values_with_first(spark, sf):
    """order_values with first, the part of the first line as text."""
    lines = steps_with_parts(spark, sf).groupBy("rollout").agg(F.array_sort(F.collect_list(F.struct("depth", "part", "price", "note"))).alias("lines"))
    rows = rollouts(spark, sf).join(lines, "rollout")
    listed = F.transform("lines", lambda x: F.struct(x["part"].alias("part_no"), x["price"].alias("price"), x["note"].alias("note")))
    placed = F.struct(F.col("uid").alias("by"), "status")
    return rows.select("rollout", F.get("lines", F.lit(0))["part"].cast("string").alias("first"), F.to_json(F.struct(F.col("rollout").alias("order_id"), placed.alias("placed"), listed.alias("lines"))).alias("doc"))


def steps_with_parts(spark, sf):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]
    depth = F.row_number().over(Window.partitionBy("rollout").orderBy(*order)) - 1  # by the name that groups and joins use, so that one shuffle serves all
    note = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("Error: returned "), F.col("l_partkey").cast("string")))
    return table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "rollout").select("rollout", depth.alias("depth"), F.col("l_partkey").alias("part"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"), note.alias("note"))


@query(f"""WITH {LINES_SQL} SELECT rollout, 'value.lines[' || depth || '].' || f AS path, v AS scalar FROM (SELECT rollout, depth, unnest(['part_no', 'price', 'note']) AS f, unnest([part::VARCHAR, price::VARCHAR, CASE WHEN flag = 'R' THEN 'Error: returned ' || part END]) AS v FROM steps) WHERE v IS NOT NULL
UNION ALL SELECT o_orderkey, unnest(['value.order_id', 'value.placed.by', 'value.placed.status']), unnest([o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus]) FROM orders WHERE o_orderkey IN (SELECT rollout FROM steps)""")
def nested_scalars(spark, sf):
    return N.scalar_paths(order_values(spark, sf), "doc", depth=LEVELS).select("rollout", "path", "scalar")


@query(f"""WITH {LINES_SQL} SELECT rollout, 'value.lines[' || min(depth) || '].note' AS path, 'Error: returned ' || min_by(part, depth) AS error FROM steps WHERE flag = 'R' GROUP BY 1""")
def nested_errors(spark, sf):
    nodes = N.value_nodes(order_values(spark, sf), "doc", only=["nth", "path", "parent", "name", "kind", "text"], where=N.speaks)
    return N.first_errors(nodes, ["rollout"])


@query(f"""WITH {LINES_SQL} SELECT rollout, kind, CAST(sum(n) AS BIGINT) AS nodes, CAST(max(deep) AS INTEGER) AS deepest FROM (SELECT rollout, unnest(['integer', 'string', 'object']) AS kind, unnest([2, CAST(flag = 'R' AS INTEGER), 1]) AS n, 3 + unnest([0, 0, -1]) AS deep FROM steps
  UNION ALL SELECT o_orderkey, unnest(['integer', 'integer', 'string', 'object', 'object', 'array']), 1, unnest([1, 2, 2, 0, 1, 1]) FROM orders WHERE o_orderkey IN (SELECT rollout FROM steps)) WHERE n > 0 GROUP BY 1, 2""")
def nested_nodes(spark, sf):
    return N.value_nodes(order_values(spark, sf), "doc", only=["kind", "ancestors"]).groupBy("rollout", "kind").agg(F.count("*").alias("nodes"), F.max(F.size("ancestors")).alias("deepest"))


@query("""SELECT o_orderkey AS rollout, unnest(['order_id', 'placed.by', 'placed.status']) AS label, unnest([o_orderkey::VARCHAR, o_custkey::VARCHAR, o_orderstatus]) AS text FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def flattened_members(spark, sf):
    return N.flat_members(N.value_nodes(order_values(spark, sf), "doc"), ["rollout"], ".").select("rollout", F.explode("members").alias("label", "text"))


@query(f"""WITH {LINES_SQL}, k AS (SELECT rollout FROM steps GROUP BY 1 HAVING count(*) > 1 AND count(*) = count(DISTINCT part)) SELECT rollout, 'value.lines' AS collection, part::VARCHAR AS identity, 'value.lines[' || depth || ']' AS item_path FROM steps JOIN k USING (rollout)""")
def candidate_collections(spark, sf):
    values = N.value_nodes(order_values(spark, sf), "doc", only=N.INSIDE, packed=True)
    return N.collections_inside(values, ["part", "id"]).select("rollout", "collection", F.inline("items")).drop("item")


@query(f"""WITH {LINES_SQL}, k AS (SELECT rollout, min(price) AS lo, max(price) AS hi, min_by(part, depth) AS chosen FROM steps GROUP BY 1 HAVING count(*) > 1 AND count(*) = count(DISTINCT part)),
a AS (SELECT rollout, chosen, unnest(['cheapest', 'dearest', 'vaguest']) AS relation, unnest([lo, hi, NULL]) AS extreme FROM k),
t AS (SELECT rollout, relation, extreme, chosen, list(part::VARCHAR ORDER BY part::VARCHAR) FILTER (price = extreme) AS tied FROM a JOIN steps USING (rollout) GROUP BY ALL)
SELECT rollout, relation, CASE WHEN extreme IS NOT NULL THEN 'price' END AS field, extreme::DOUBLE AS extreme, CASE WHEN extreme IS NOT NULL THEN tied END AS tied,
  CASE WHEN extreme IS NULL THEN 'not_recoverable' WHEN NOT list_contains(tied, chosen::VARCHAR) THEN 'not_extreme' WHEN len(tied) > 1 THEN 'tie' ELSE 'resolved' END AS status FROM t""")
def superlative_choices(spark, sf):
    values = N.value_nodes(values_with_first(spark, sf), "doc", only=N.INSIDE, packed=True)
    found = N.compared(N.collections_inside(values, ["part"], fields=True))
    kinds = [("cheapest", "min", "the cheapest one by price"), ("dearest", "max", "the one of the dearest price"), ("vaguest", "max", "any of them")]
    asked = found.select("rollout", F.col("first").alias("selected"), "compared", F.inline(F.array(*[F.struct(F.lit(r).alias("relation"), F.lit(d).alias("direction"), F.lit("amount").alias("family"), F.lit(q).alias("query")) for r, d, q in kinds])))
    return N.chosen(asked, {}).select("rollout", "relation", "field", "extreme", "tied", "status")


@query(f"""WITH {LINES_SQL}, c AS (SELECT rollout, list_sort(list(DISTINCT part::VARCHAR)) AS candidates FROM steps GROUP BY 1)
SELECT rollout, candidates, CAST(len(candidates) AS INTEGER) AS ambiguity, CASE WHEN rollout % 5 = 0 THEN 'still_exposed' WHEN len(candidates) = 1 THEN 'recoverable' ELSE 'missing' END AS decision FROM c""")
def withheld_parameters(spark, sf):
    visible = N.value_nodes(order_values(spark, sf), "doc").select("rollout", F.lit("get_order").alias("producer"), "path", "kind", "text")
    first = steps_with_parts(spark, sf).where("depth = 0").select("rollout", F.lit("part_no").alias("parameter"), F.col("part").cast("string").alias("target"))
    withheld = first.withColumn("query", F.when(F.col("rollout") % 5 == 0, F.concat(F.lit("send part "), "target", F.lit(" again"))).otherwise("send it again"))
    return N.recoverability(withheld, visible, ["rollout"], ["no", "value", "lines", "get"]).drop("parameter")


@query("""SELECT l_suppkey, CASE WHEN count(*) > 20 THEN count(*) END AS items, CAST(least(count(*), 20) AS INTEGER) AS shown, CAST(least(count(*), 7) AS INTEGER) AS bounded FROM lineitem GROUP BY 1""")
def bounded_views(spark, sf):
    doc = F.to_json(F.collect_list(F.struct("l_partkey", "l_quantity")))
    rows = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(doc.alias("doc")).withColumns({"seen": N.preview(F.col("doc")), "cut": N.bounded(F.col("doc"), most=7)})
    items = F.get_json_object("seen", "$.original_items").cast("long")
    shown = F.coalesce(F.get_json_object("seen", "$.preview"), F.col("seen"))
    return rows.select("l_suppkey", items.alias("items"), F.json_array_length(shown).alias("shown"), F.json_array_length("cut").alias("bounded"))
