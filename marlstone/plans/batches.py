"""Registered queries of batch operators and of values of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches as B
from ..functions import values as V
from ..operators import rows as R
from .queries import query, r6
from .tables import STEPS_SQL, rollouts, steps, table


@query("""SELECT o_orderkey AS rollout, o_orderstatus AS state FROM orders""")
def popped_and_renamed(spark, sf):
    kept, _ = B.popped(rollouts(spark, sf), ["rollout", "status"])
    return B.renamed(kept, ["status"], ["state"])


@query("""WITH n AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS row_id FROM customer) SELECT k, CAST(row_id AS BIGINT) AS row_id, CAST(pos AS INT) AS pos FROM n JOIN (VALUES (0, 5), (1, 3), (2, 5)) p(pos, row_id) USING (row_id)""")
def rows_by_numbers(spark, sf):
    rows = R.numbered(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), ["k"])
    return B.item(rows, "row_id", [5, 3, 5])


@query("""SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS n_nationkey, list(n_name ORDER BY n_nationkey) AS n_name FROM nation GROUP BY 1""")
def rows_as_columns(spark, sf):
    return B.columns_of(table(spark, sf, "nation"), ["n_regionkey"], "n_nationkey")


@query("""SELECT event_id, coalesce(nullif(CASE WHEN event_type = 'click' THEN '' ELSE event_type END, ''), user_id::VARCHAR) AS id FROM events""")
def checked_ids(spark, sf):
    return table(spark, sf, "events").select("event_id", B.checked_id(F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type")), F.col("user_id")).alias("id"))


@query("""SELECT c_custkey AS uid FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)""")
def held_out_rows(spark, sf):
    return B.held_out(table(spark, sf, "customer").select(F.col("c_custkey").alias("uid")), rollouts(spark, sf).where("score > 200000"), "uid")


@query("""SELECT o_orderkey AS rollout FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def selected_rows(spark, sf):
    return B.selected(rollouts(spark, sf), status="F", category="1-URGENT").select("rollout")


@query("""SELECT p_partkey FROM part WHERE coalesce(CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice END, 0) BETWEEN 0 AND 1000""")
def price_range(spark, sf):
    price = F.when(F.col("p_size") % 3 == 0, F.lit(None)).otherwise(F.col("p_retailprice"))
    return table(spark, sf, "part").where(B.within(price, 0, 1000)).select("p_partkey")


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-06-01 00:00:00'""")
def date_range(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("string").alias("text"))
    return rows.where(B.between_dates(F.col("text"), "1995-06-01 00:00:00", None)).select("o_orderkey")


@query(f"""WITH {STEPS_SQL} SELECT rollout, coalesce(string_agg(depth::VARCHAR, ', ' ORDER BY depth::VARCHAR) FILTER (abs(round((reward - 0.05) * 100 / 0.05, 2)) >= 60), '') AS changed FROM steps GROUP BY 1""")
def price_changes(spark, sf):
    change = B.percent_change(F.col("reward"), F.lit(0.05))
    return B.changed(steps(spark, sf), ["rollout"], "depth", change, 60)


@query("""SELECT doc_id FROM documents WHERE contains(lower(coalesce(text, '')), 'de') OR lower(lang) = 'de'""")
def text_or_tag_search(spark, sf):
    return table(spark, sf, "documents").where(B.matches_text_or_tag(F.coalesce("text", F.lit("")), F.array("lang"), "DE")).select("doc_id")


@query("""SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'er')""")
def text_search(spark, sf):
    return table(spark, sf, "conversations").where(B.contains_text(F.col("text"), "ER")).select("conv_id", "turn")


@query("""SELECT o_orderkey AS rollout FROM orders WHERE o_custkey = 7 AND lower(o_orderstatus) = 'f'""")
def owned_rows(spark, sf):
    return B.owned(rollouts(spark, sf), "uid", 7, "status", "F").select("rollout")


@query("""SELECT page_id FROM pages WHERE contains(string_split(url, '/')[-1], '7')""")
def found_by_name(spark, sf):
    return B.found_under(table(spark, sf, "pages"), "url", "7").select("page_id")


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') THEN 'steel' WHEN contains(lower(p_type), 'small') THEN 'small' WHEN contains(lower(p_name), 'green') THEN 'x' ELSE 'other' END AS bucket, CASE WHEN ends_with(rtrim(p_type), 'COPPER') THEN 'copper' WHEN ends_with(rtrim(p_type), 'TIN') THEN 'tin' ELSE 'none' END AS ended FROM part WHERE NOT contains(lower(p_name), 'green')""")
def text_buckets(spark, sf):
    rows = table(spark, sf, "part").where("NOT contains(lower(p_name), 'green')")
    return rows.select("p_partkey", B.bucketed(F.col("p_type"), [("STEEL", "steel"), ("small", "small")], "other").alias("bucket"), B.ended_by(F.col("p_type"), [("COPPER", "copper"), ("TIN", "tin")], "none").alias("ended"))


@query("""SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer""")
def merged_columns(spark, sf):
    rows = table(spark, sf, "customer")
    return B.merged_columns(rows.select("c_custkey", "c_name", "c_acctbal"), rows.select("c_custkey", "c_name", "c_nationkey"), "c_custkey")


@query("""SELECT uid, category, F, O FROM (SELECT o_custkey AS uid, o_orderpriority AS category, max(o_totalprice) FILTER (o_orderstatus = 'F') AS F, max(o_totalprice) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY 1, 2) WHERE F IS NOT NULL AND O IS NOT NULL""")
def in_all_models(spark, sf):
    return B.in_all(rollouts(spark, sf), ["uid", "category"], "status", ["F", "O"], "score")


@query("""SELECT c_custkey AS uid, c_name, s AS gold, n AS extra FROM customer JOIN (SELECT o_custkey, max(o_totalprice) AS s FROM orders GROUP BY 1) ON c_custkey = o_custkey LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON user_id = c_custkey""")
def joined_records(spark, sf):
    raw = table(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), "c_name")
    gold = rollouts(spark, sf).groupBy("uid").agg(F.max("score").alias("gold"))
    extra = table(spark, sf, "events").groupBy(F.col("user_id").alias("uid")).agg(F.count("*").alias("extra"))
    return B.records(raw, gold, extra, "uid")


@query("""WITH c AS (SELECT DISTINCT word FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part WHERE p_partkey <= 40) WHERE length(word) > 3), f AS (SELECT p_partkey, min(word) AS word FROM part JOIN c ON contains(p_name, word) GROUP BY 1 HAVING count(DISTINCT word) = 1) SELECT p_partkey, word FROM f""")
def identified_by_phrase(spark, sf):
    part = table(spark, sf, "part")
    words = part.where("p_partkey <= 40").select(F.explode(F.split("p_name", " ")).alias("word")).where("length(word) > 3").distinct().withColumn("phrase", F.col("word"))
    return B.identified(part.select("p_partkey", "p_name"), words, "p_partkey", "p_name", "word", "phrase")


@query("""WITH a AS (SELECT n_regionkey AS r, n_nationkey AS p, min(s_suppkey) AS l FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2), b AS (SELECT n_regionkey AS r, min(s_suppkey) AS m, count(DISTINCT s_suppkey) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
SELECT c_custkey, coalesce(l, CASE WHEN n = 1 THEN m END) AS supplier, l IS NULL AND coalesce(n, 0) > 1 AS ambiguous FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN a ON a.r = n_regionkey AND a.p = c_nationkey LEFT JOIN b ON b.r = n_regionkey""")
def local_preference(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_regionkey").alias("r"))
    rows = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("place")).join(nation, "place")
    catalog = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("place")).join(nation, "place")
    return B.preferring_local(rows, catalog, ["r"], "place", "supplier").select("c_custkey", "supplier", "ambiguous")


@query("""WITH s AS (SELECT user_id, list(event_type ORDER BY event_id) AS t FROM events GROUP BY 1), m AS (SELECT user_id, array_to_string(list_transform(t, lambda x: x[1:2]), '') AS x FROM s) SELECT user_id, regexp_matches(x, 'pu.*er.*vi') AS found FROM m""")
def ordered_subsequences(spark, sf):
    held = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda h: h["event_type"]).alias("t"))
    return held.select("user_id", B.is_subsequence(F.array(F.lit("purchase"), F.lit("error"), F.lit("view")), F.col("t")).alias("found"))


@query("""WITH g AS (SELECT o_custkey AS uid, o_orderstatus AS attribute, max(o_totalprice) AS v FROM orders GROUP BY 1, 2), m AS (SELECT o_custkey AS uid, o_orderstatus AS attribute, max(o_totalprice) AS v FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY 1, 2)
SELECT g.uid, g.attribute, g.v AS gold, m.v AS model FROM g LEFT JOIN m USING (uid, attribute) WHERE g.v IS DISTINCT FROM m.v""")
def state_differences(spark, sf):
    state = lambda rows: rows.groupBy("uid", F.col("status").alias("attribute")).agg(F.max("score").alias("v"))
    rows = rollouts(spark, sf)
    return B.state_differences(state(rows.where("category != '5-LOW'")), state(rows), ["uid"], "attribute", "v")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL), m AS (SELECT doc_id - 1 AS doc_id, l, line FROM l)
SELECT doc_id, line::INT AS line, md5(l.l) AS "left", md5(m.l) AS "right" FROM l JOIN m USING (doc_id, line) WHERE l.l IS DISTINCT FROM m.l""")
def line_differences(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    out = B.line_differences(docs, docs.withColumn("doc_id", F.col("doc_id") - 1), "doc_id", "text")
    return out.select("doc_id", "line", F.md5("left").alias("left"), F.md5("right").alias("right"))


@query("""SELECT l_orderkey, l_suppkey AS producer, list(DISTINCT l_partkey ORDER BY l_partkey) AS consumers FROM lineitem GROUP BY 1, 2""")
def dependency_consumers(spark, sf):
    calls = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.array("l_suppkey").alias("needs"))
    return B.consumers(calls, "l_orderkey", "l_partkey", "needs")


@query("""SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def catalog_lookup(spark, sf):
    rows = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    return B.looked_up(rows, table(spark, sf, "nation"), "n_nationkey", "n_name").select("s_suppkey", "n_name")


@query("""SELECT o_orderkey AS rollout, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'SUCCEEDED' ELSE o_orderstatus END AS status FROM orders""")
def repaired_status(spark, sf):
    done = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("rollout"))
    return B.repaired_status(done, rollouts(spark, sf).select("rollout", "status"), "rollout")


@query("""SELECT n_nationkey AS row_id, (n_nationkey * 7 % 25)::BIGINT AS pos, n_name FROM nation""")
def reordered_rows(spark, sf):
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("row_id"), "n_name")
    permutation = spark.range(25).select((F.col("id") * 7 % 25).alias("pos"), F.col("id").cast("int").alias("row_id"))
    return B.reordered(nation, "row_id", B.inverse(B.inverse(permutation, "row_id"), "row_id"))


@query("""SELECT (n_nationkey // 4)::BIGINT AS bucket, list(n_name ORDER BY n_nationkey) AS n_name, list(n_regionkey ORDER BY n_nationkey) AS n_regionkey FROM nation GROUP BY 1""")
def folded_rows(spark, sf):
    return B.folded(table(spark, sf, "nation"), "n_nationkey", 4, ["n_name", "n_regionkey"])


@query("""SELECT n_nationkey::BIGINT AS row_id, n_name, n_regionkey FROM nation""")
def unfolded_rows(spark, sf):
    return B.unfolded(folded_rows(spark, sf), "bucket", 4, ["n_name", "n_regionkey"])


@query("""SELECT vec_id, chunk::INT AS chunk, embedding[chunk * 16 + 1 : chunk * 16 + 16] AS embedding FROM embeddings, range(4) t(chunk) WHERE len(embedding) = 64""")
def unfolded_chunks(spark, sf):
    rows = table(spark, sf, "embeddings").where("size(embedding) = 64").select("vec_id", "embedding")
    return B.unfolded_chunks(rows, "embedding", 4).withColumn("chunk", F.col("chunk").cast("int"))


@query("""SELECT n_nationkey, n_name FROM nation UNION ALL SELECT 24 + k, n_name FROM nation, range(1, 4) t(k) WHERE n_nationkey = 0""")
def edge_copies(spark, sf):
    return B.with_edge_copies(table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"), "n_nationkey", 3, last=False)


@query("""SELECT k, CAST(row_number() OVER (ORDER BY k) - 1 AS BIGINT) AS row_id FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT s_suppkey + 1000000 FROM supplier)""")
def united_tables(spark, sf):
    parts = [table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf, "supplier").select((F.col("s_suppkey") + 1000000).alias("k"))]
    return B.united(parts, "row_id", ["k"])


@query("""SELECT min(o_orderkey) AS rollout FROM orders GROUP BY o_custkey, o_orderstatus""")
def unique_contents(spark, sf):
    return B.unique_content(rollouts(spark, sf), ["uid", "status"], "rollout").select("rollout")


@query("""WITH c AS (SELECT user_id, event_id, unnest([event_type, event_type]) AS call, unnest([0, 1]) AS j FROM events) SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id, j) - 1 AS INT) AS place, call FROM c""")
def flattened_calls(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "event_id", F.array("event_type", "event_type").alias("calls"))
    return B.flattened_calls(rows, ["user_id"], "event_id", "calls")


@query("""SELECT c_custkey FROM customer ORDER BY c_custkey""")
def sequential_sampler(spark, sf):
    return B.sampler(table(spark, sf, "customer"), "c_custkey").select("c_custkey")


@query("""SELECT true AS all_used, true AS all_covered, true AS none_twice""")
def covering_parts(spark, sf):
    items = table(spark, sf, "part").select("p_partkey")
    return B.covering_parts(items.withColumn("part", F.col("p_partkey") % 5), items, "p_partkey", "part", 5)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey % 10 AS g, l_linenumber AS a, l_linenumber + 1 + l_partkey % 2 AS b FROM lineitem), w AS (SELECT g, b, 2 AS d FROM e UNION SELECT w.g, e.b, d + 1 FROM w JOIN e ON w.g = e.g AND w.b = e.a) SELECT g, max(d)::INT AS depth FROM w GROUP BY 1""")
def longest_paths(spark, sf):
    edges = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("g"), F.col("l_linenumber").cast("long").alias("a"), (F.col("l_linenumber") + 1 + F.col("l_partkey") % 2).alias("b"))
    return B.longest_paths(edges, "g", "a", "b")


@query("""SELECT event_id, CASE WHEN event_type = 'signup' THEN -1.0 WHEN value > 10 AND user_id % 2 = 0 AND event_type <> 'error' THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM events""")
def turn_scores(spark, sf):
    return table(spark, sf, "events").select("event_id", V.turn_score(F.col("event_type") != "signup", F.col("value") > 10, F.col("user_id") % 2 == 0, F.col("event_type") != "error").alias("score"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(l_tax - 0.1 * l_discount * (l_returnflag = 'R')::INT, 6) AS shaped, round(l_tax - (l_tax - l_discount) * 0.05, 6) AS ratio, round(pow(l_tax - l_discount - 2 * (l_quantity / 50 - 0.5), 2), 6) AS squared,
round(greatest(l_tax * 5, 0) - l_tax * 5 * (l_returnflag = 'R')::INT + ln(1 + exp(-abs(l_tax * 5))), 6) AS cross, (sign(l_tax - 0.04) = sign((l_returnflag = 'R')::INT * 2 - 1))::INT::DOUBLE AS side, (l_quantity / 25 < 0.8 OR l_quantity / 25 > 1.2)::INT::DOUBLE AS clipped FROM lineitem""")
def more_token_losses(spark, sf):
    tax, discount, kind = F.col("l_tax"), F.col("l_discount"), (F.col("l_returnflag") == "R").cast("int")
    columns = {"shaped": V.kl_shaped(tax, discount, 0.1, kind), "ratio": V.ratio_reward(tax, tax, discount, 0.05), "squared": V.squared_preference_loss(tax, discount, F.col("l_quantity") / 50, 2.0), "cross": V.reward_cross_entropy(tax, kind, 5.0)}
    rows = table(spark, sf, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[r6(c).alias(n) for n, c in columns.items()], V.same_sign(tax - 0.04, kind).alias("side"), V.clip_fraction(F.col("l_quantity") / 25).alias("clipped"))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE len(embedding) > 5), z AS (SELECT vec_id, e, ln(list_sum(list_transform(e, lambda x: exp(x)))) AS z FROM v)
SELECT vec_id, round(z - list_sum(list_transform(e, lambda x: x * exp(x - z))), 5) AS entropy, round(e[4] - z, 5) AS logp FROM z""")
def logit_entropies(spark, sf):
    rows = table(spark, sf, "embeddings").where("size(embedding) > 5").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return rows.select("vec_id", F.round(V.entropy(F.col("e")), 5).alias("entropy"), F.round(V.log_probability(F.col("e"), F.lit(3)), 5).alias("logp"))


@query("""SELECT p_partkey, CASE WHEN p_size - 10 >= 0 AND p_size - 10 < 20 AND 20 <= 30 THEN p_size - 10 END AS start, greatest(p_size - 12, 0) AS relative_start, least(p_size - 2, 30) AS relative_end, p_size - 12 >= 0 AND p_size - 2 <= 30 AS reliable FROM part""")
def spans_checked(spark, sf):
    size = F.col("p_size")
    span, relative = V.span_or_null(size - 10, F.lit(20), F.lit(30)), V.relative_span(size, size + 10, F.lit(12), F.lit(30))
    return table(spark, sf, "part").select("p_partkey", span["start"].alias("start"), relative["start"].alias("relative_start"), relative["end"].alias("relative_end"), relative["reliable"].alias("reliable"))


@query("""SELECT s_suppkey, round(s_acctbal + s_nationkey, 4) AS sum, CASE WHEN s_nationkey = 0 THEN NULL ELSE round(s_acctbal / s_nationkey, 2) END AS quotient, CASE WHEN s_nationkey = 0 THEN 'Cannot divide by zero' END AS error, round(CASE WHEN s_nationkey % 2 = 0 THEN s_acctbal * 1.1 ELSE s_acctbal / 2 END, 1) AS exchanged FROM supplier""")
def arithmetic_tools(spark, sf):
    a, b = F.col("s_acctbal"), F.col("s_nationkey")
    quotient = V.calculated(a, b, "divide")
    money = V.exchanged(a, F.when(b % 2 == 0, 1.1), F.lit(2.0))
    return table(spark, sf, "supplier").select("s_suppkey", F.round(V.calculated(a, b, "add")["result"], 4).alias("sum"), F.round(quotient["result"], 2).alias("quotient"), quotient["error"].alias("error"), F.round(money, 1).alias("exchanged"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN value END AS number, CASE WHEN event_type = 'view' THEN ts END AS at, CASE WHEN event_type = 'error' THEN TIMESTAMP '2024-03-09 00:00:00' END AS day FROM events""")
def comparable_texts(spark, sf):
    kind = F.col("event_type")
    text = F.when(kind == "click", F.col("value").cast("string")).when(kind == "view", F.col("ts").cast("string")).when(kind == "error", "3/9/2024").otherwise("no value")
    found = V.comparable(text)
    return table(spark, sf, "events").select("event_id", found["number"].alias("number"), F.when(kind == "view", found["at"]).cast("timestamp_ntz").alias("at"), F.when(kind == "error", found["at"]).cast("timestamp_ntz").alias("day"))


@query("""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 0.0 WHEN contains(p_name, 'a') OR contains(p_name, 'zz') THEN 1.0 ELSE 0.1 END::DOUBLE AS score FROM part""")
def sub_match_scores(spark, sf):
    answer = F.when(F.col("p_size") % 5 != 0, F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", V.sub_match_score(answer, F.array(F.lit("a"), F.lit("zz")), 1.0, 0.1).alias("score"))


@query("""SELECT n_nationkey, (n_nationkey % 3 > 0 AND n_nationkey % 3 < 3)::BOOLEAN AS mentioned FROM nation""")
def numbers_mentioned(spark, sf):
    n = F.col("n_nationkey")
    text = F.when(n % 3 == 0, F.concat(F.lit("item "), (n + 100).cast("string"), n.cast("string"))).when(n % 3 == 1, F.concat(F.lit("the "), n.cast("string"), F.lit("th one"))).otherwise(F.concat(F.lit("was "), n.cast("string"), F.lit(".")))
    return table(spark, sf, "nation").select("n_nationkey", V.number_mentioned(n, text).alias("mentioned"))


@query("""WITH w AS (SELECT p_partkey, lower(unnest(string_split(p_type, ' '))) || (CASE WHEN p_size % 2 = 0 THEN 'ies' ELSE 's' END) AS t FROM part) SELECT p_partkey, t, CASE WHEN regexp_matches(t, '^.{2,}ies$') THEN regexp_replace(t, 'ies$', 'y') WHEN regexp_matches(t, '(ss|x|ch|sh)es$') THEN regexp_replace(t, 'es$', '') WHEN regexp_matches(t, '^.{3,}[^s]s$') THEN regexp_replace(t, 's$', '') ELSE t END AS singular FROM w""")
def singular_tokens(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_size", F.explode(F.split(F.lower("p_type"), " ")).alias("w"))
    rows = rows.select("p_partkey", F.concat("w", F.when(F.col("p_size") % 2 == 0, "ies").otherwise("s")).alias("t"))
    return rows.select("p_partkey", "t", V.singular(F.col("t")).alias("singular"))


@query("""SELECT p_partkey, contains(lower(p_name || ' make order'), 'make_order') OR contains(lower(p_name || ' make order'), 'make order') AS leaks FROM part""")
def names_leaked(spark, sf):
    return table(spark, sf, "part").select("p_partkey", V.leaks_name(F.concat("p_name", F.lit(" Make order")), F.lit("make_order")).alias("leaks"))


@query("""WITH v AS (SELECT vec_id, range(vec_id % 9) AS ids FROM embeddings) SELECT vec_id, list_transform(CASE WHEN len(ids) <= 4 THEN ids ELSE ids[len(ids) - 3 : len(ids)] END, lambda x: x::INT) AS l, list_transform(CASE WHEN len(ids) <= 4 THEN ids ELSE ids[1:4] END, lambda x: x::INT) AS r, list_transform(CASE WHEN len(ids) <= 4 THEN ids ELSE list_concat(ids[1:2], ids[len(ids) - 1 : len(ids)]) END, lambda x: x::INT) AS m,
list_transform(list_concat(list_transform(range(greatest(6 - len(ids), 0)), lambda x: -1), ids), lambda x: x::INT) AS p FROM v""")
def truncated_and_padded(spark, sf):
    n = (F.col("vec_id") % 9).cast("int")
    ids = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).otherwise(F.expr("cast(array() as array<int>)"))
    rows = table(spark, sf, "embeddings").select("vec_id", ids.alias("ids"))
    return rows.select("vec_id", *[V.truncated(F.col("ids"), 4, s).alias(s[0]) for s in ("left", "right", "middle")], V.padded_to(F.col("ids"), 6, -1).alias("p"))


@query("""SELECT vec_id, ids[3:5] AS kept, [0, 1, 1] AS tail, 30 AS first FROM (SELECT vec_id, [0, 0, 30, 40, 50] AS ids FROM embeddings)""")
def masks_applied(spark, sf):
    ids, mask = F.array(*[F.lit(x) for x in (0, 0, 30, 40, 50)]), F.array(*[F.lit(x) for x in (0, 0, 1, 1, 1)])
    shifted = F.array(*[F.lit(x) for x in (1, 1, 0, 1, 1)])
    return table(spark, sf, "embeddings").select("vec_id", V.without_padding(ids, mask).alias("kept"), B.last_positions(shifted, F.lit(3)).alias("tail"), B.first_unmasked(ids, mask).alias("first"))


@query("""SELECT n_nationkey, unnest(['text', 'image', 'text', 'video']) AS type, unnest(['see ', NULL, ' then ' || n_name, NULL]) AS text FROM nation""")
def message_segments(spark, sf):
    text = F.concat(F.lit("see <image> then "), "n_name", F.lit("<video>"))
    return table(spark, sf, "nation").select("n_nationkey", F.inline(V.content_segments(text)))


@query("""SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 0.0 WHEN p_size % 4 = 1 THEN 1.0 WHEN p_size % 4 = 2 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM part""")
def first_tool_scores(spark, sf):
    k = F.col("p_size") % 4
    given = F.when(k == 1, F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))).when(k == 2, F.create_map(F.lit("a"), F.lit("9"))).otherwise(F.create_map(F.lit("z"), F.lit("1")))
    score = V.first_tool_score(F.when(k == 0, "other").otherwise("f"), given, F.lit("f"), F.create_map(F.lit("a"), F.lit("1")))
    return table(spark, sf, "part").select("p_partkey", score.alias("score"))


@query("""SELECT n_nationkey AS step, round(CASE WHEN n_nationkey < 4 THEN n_nationkey / 4 ELSE 1 END, 6) AS constant, round(CASE WHEN n_nationkey < 4 THEN n_nationkey / 4 WHEN n_nationkey < 12 THEN 1 WHEN n_nationkey < 20 THEN 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (n_nationkey - 12) / 8)) ELSE 0.1 END, 6) AS wsd FROM nation""")
def more_schedules(spark, sf):
    step = F.col("n_nationkey")
    return table(spark, sf, "nation").select(step.alias("step"), r6(V.schedule(step, "constant", 4, 20)).alias("constant"), r6(V.schedule(step, "wsd", 4, 20, 0.5, 0.1)).alias("wsd"))


@query("""SELECT vec_id, round((embedding[1]::DOUBLE + embedding[3]::DOUBLE) / 2, 5) AS pooled FROM embeddings WHERE len(embedding) > 3""")
def pooled_vectors(spark, sf):
    e = F.col("embedding").cast("array<double>")
    vectors = F.transform(F.slice(e, 1, 3), lambda x: F.array(x))
    return table(spark, sf, "embeddings").where("size(embedding) > 3").select("vec_id", F.round(F.get(V.mean_pooled(vectors, F.array(F.lit(1), F.lit(0), F.lit(1))), F.lit(0)), 5).alias("pooled"))
