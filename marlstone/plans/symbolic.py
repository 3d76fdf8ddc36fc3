"""Registered queries of answers by form and by value: each order states an answer in one of several ways; the SQL knows which are right."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import symbolic as S
from .queries import query
from .tables import table

NUMBERS = "SELECT o_orderkey, o_orderkey % 5 AS way, o_custkey AS p, o_orderkey % 97 AS q FROM orders"


def answers(spark, sf, ways: list[tuple[str, str]]):
    """o_orderkey, given, gold: texts in which {p} and {q} stand for the order's numbers, by o_orderkey modulo the ways."""
    key = F.col("o_orderkey")
    p, q = F.col("o_custkey").cast("string"), (key % 97).cast("string")
    filled = lambda text: F.replace(F.replace(F.lit(text), F.lit("<p>"), p), F.lit("<q>"), q)
    pick = lambda k: F.element_at(F.array(*[filled(w[k]) for w in ways]), (key % len(ways)).cast("int") + 1)
    return table(spark, sf, "orders").select("o_orderkey", pick(0).alias("given"), pick(1).alias("gold"))


@query(f"""SELECT o_orderkey, CASE way WHEN 0 THEN 1 WHEN 1 THEN 0 WHEN 2 THEN 0 WHEN 3 THEN 1 ELSE CAST(q < 10 AS INTEGER) END::DOUBLE AS score FROM ({NUMBERS})""")
def boxed_forms(spark, sf):
    ways = [(r"we have \boxed{1} so \boxed{\dfrac{<p>}{<q>}}$.", "<p>/<q>"), (r"\boxed{<q>\text{ cm}}", "<q>1"), ("the answer is x = <q>", "<q>"), (r"\fbox{ x=<q>}", "<q>"), (r"\boxed{{2}} or \boxed{\sqrt<q>}", r"\sqrt{<q>}")]
    rows = answers(spark, sf, ways)
    return rows.select("o_orderkey", S.boxed_score(F.col("given"), F.col("gold")).alias("score"))


@query(f"""SELECT o_orderkey, CASE WHEN way IN (0, 1, 4) THEN 1.0 ELSE -1.0 END AS score, CASE way WHEN 0 THEN p || '' WHEN 1 THEN '\\frac{{' || p || '}}{{' || q || '}}' WHEN 2 THEN '[INVALID]' WHEN 3 THEN q || '1' ELSE 'x' || q END AS answer FROM ({NUMBERS})""")
def verified_answers(spark, sf):
    ways = [("Long work.\nAnswer: <p> dollars", "<p>"), (r"Answer: 5" + "\n" + r"ANSWER : y = \frac{<p>}{<q>}", r"\frac{<p>}{<q>}"), ("It is <q>.", "<q>"), (r"Answer: $\text{<q>1}$ ways", "<q>"), ("Answer: a x<q> mph", "x<q>")]
    rows = answers(spark, sf, ways)
    return rows.select("o_orderkey", S.verified(F.col("given"), F.col("gold")).alias("v")).select("o_orderkey", "v.score", "v.answer")


@query(f"""SELECT o_orderkey, CASE way WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN q % 2 = 1 WHEN 3 THEN true ELSE p % 10 = 0 END AS right FROM ({NUMBERS})""")
def graded_values(spark, sf):
    ways = [("<q>x+<q>y", "<q>(x+y)"), ("(<q>,<p>)", "(<q>,<p>+1)"), ("<q>/2", "half<q>"), (r"[<p> cm, \sqrt{18}]", r"[<p>,3\sqrt2]"), ("<p>.0 degrees", "last<p>")]
    rows = answers(spark, sf, ways)
    gold = F.when(F.col("gold").startswith("half"), (F.substring("gold", 5, 9).cast("double") / 2).cast("string")).when(F.col("gold").startswith("last"), F.concat(F.floor(F.substring("gold", 5, 19).cast("long") / 10).cast("string"), F.lit("0"))).otherwise(F.col("gold"))
    return rows.select("o_orderkey", S.grade(F.col("given"), gold).alias("right"))
