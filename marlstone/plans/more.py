"""Further registered queries: positions, runs, reports, text tools, lexical search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rows as R
from ..operators import retrieval, select
from .queries import query, r6
from .tables import CODES_SQL, STEPS_SQL, coded_events, rollouts, steps, table


@query("""WITH n AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) - 1 AS row_id FROM customer) SELECT k, CAST(row_id AS BIGINT) AS row_id FROM n WHERE row_id >= 10 AND row_id < 1000 AND (row_id - 10) % 7 = 0""")
def positional_slice(spark, sf):
    rows = R.numbered(table(spark, sf, "customer").select(F.col("c_custkey").alias("k")), ["k"])
    return R.every(rows, "row_id", 10, 1000, 7)


@query("""SELECT n_nationkey AS k, CAST(rep AS INT) AS rep FROM nation, range(n_regionkey) t(rep)""")
def repeated_rows(spark, sf):
    return R.repeated(table(spark, sf, "nation"), F.col("n_regionkey")).select(F.col("n_nationkey").alias("k"), "rep")


@query("""WITH n AS (SELECT n_nationkey AS k, CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS row_id FROM nation) SELECT * FROM n UNION ALL SELECT k, row_id + 25 FROM n WHERE row_id < 7""")
def padded_rows(spark, sf):
    rows = R.numbered(table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")), ["k"])
    return R.padded(rows, "row_id", 32).withColumn("row_id", F.col("row_id").cast("long"))


@query(f"""WITH {CODES_SQL}, c AS (SELECT user_id, event_id, CAST(code IS DISTINCT FROM lag(code) OVER w OR lag(1) OVER w IS NULL AS INT) AS new FROM coded WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY (SELECT ts FROM events e WHERE e.event_id = c.event_id), event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM c""")
def code_runs(spark, sf):
    return R.runs(coded_events(spark, sf), ["user_id"], ["ts", "event_id"], "code").select("user_id", "event_id", "run")


@query(f"""WITH {CODES_SQL}, g AS (SELECT user_id, day, min(CASE WHEN code = -3 THEN event_id END) AS a, max(CASE WHEN code = -3 THEN event_id END) AS z, max(CASE WHEN code <> -3 THEN event_id END) AS ok FROM coded GROUP BY ALL)
SELECT user_id, day, coalesce(ok > a, false) AS recovered, coalesce(ok > z, false) AS strict FROM g WHERE a IS NOT NULL""")
def parse_recoveries(spark, sf):
    return R.recoveries(coded_events(spark, sf), ["user_id", "day"], "event_id", F.col("code") == -3)


@query(f"""WITH {STEPS_SQL} SELECT rollout, depth, CAST(depth AS INT) AS step, CASE WHEN flag = 'R' THEN CAST(sum(CAST(flag = 'R' AS INT)) OVER (PARTITION BY rollout ORDER BY depth ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) END AS call FROM steps""")
def step_counters(spark, sf):
    return R.attempts(steps(spark, sf), ["rollout"], ["depth"], F.col("flag") == "R").select("rollout", "depth", "step", "call")


@query(f"""WITH {CODES_SQL}, d AS (SELECT day, avg(value) AS v FROM coded GROUP BY day ORDER BY day DESC LIMIT 5) SELECT round(avg(v), 5) AS mean FROM d""")
def last_five_days(spark, sf):
    days = coded_events(spark, sf).groupBy("day").agg(F.avg("value").alias("v"))
    return R.last_mean(days, ["day"], "v").select(F.round("mean", 5).alias("mean"))


@query(f"""WITH {CODES_SQL}, u AS (SELECT user_id, avg(CAST(code = 1 AS DOUBLE)) AS r, count(*) AS n FROM coded GROUP BY 1) SELECT round(sum(r * n) / sum(n), 6) AS micro, round(avg(r), 6) AS macro FROM u""")
def micro_and_macro(spark, sf):
    return R.micro_macro(coded_events(spark, sf), "user_id", F.col("code") == 1).select(r6(F.col("micro")).alias("micro"), r6(F.col("macro")).alias("macro"))


@query("""WITH m AS (SELECT o_orderkey AS rollout, avg(o_totalprice) OVER (PARTITION BY o_custkey) AS m FROM orders) SELECT rollout FROM m WHERE m BETWEEN 200000 AND 260000""")
def accuracy_band(spark, sf):
    return R.band(rollouts(spark, sf), ["uid"], "score", 200000, 260000).select("rollout")


@query("""SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type AS linked FROM events""")
def state_chain(spark, sf):
    return R.chained(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type", "event_type").select("event_id", "linked")


@query("""WITH f AS (SELECT user_id, event_type, min((ts, event_id)) AS first FROM events GROUP BY ALL)
SELECT e.event_id, CAST(count(*) AS INT) AS n_known, (e.ts, e.event_id) = max(CASE WHEN f.event_type = e.event_type THEN f.first END) AS fresh FROM events e JOIN f ON f.user_id = e.user_id AND f.first <= (e.ts, e.event_id) GROUP BY e.event_id, e.ts""")
def running_tools(spark, sf):
    return R.running_set(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", F.size("known").alias("n_known"), "fresh")


@query("""WITH c AS (SELECT l_suppkey AS k, l_orderkey, list_distinct(list(l_returnflag)) AS f FROM lineitem GROUP BY ALL), e AS (SELECT k, unnest(f) AS c FROM c), n AS (SELECT k, c, count(*) AS n FROM e GROUP BY ALL), a AS (SELECT k, count(*) AS a FROM c GROUP BY 1)
SELECT a.k, coalesce(string_agg(n.c, ',' ORDER BY n.c), '') AS common, count(n.c) = 1 AS "unique" FROM a LEFT JOIN n ON n.k = a.k AND n.n = a.a GROUP BY a.k""")
def class_intersections(spark, sf):
    per = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k"), "l_orderkey").agg(F.collect_set("l_returnflag").alias("f"))
    return R.common_classes(per, "k", "f").select("k", F.array_join("common", ",").alias("common"), "unique")


@query("""SELECT doc_id, array_to_string(list_sort(string_split(text, chr(10))), chr(10)) AS sorted_text, array_to_string(string_split(text, chr(10))[-3:], chr(10)) AS tail FROM documents""")
def line_tools(spark, sf):
    lines = F.split("text", "\n")
    tail = F.slice(lines, F.greatest(F.size(lines) - 2, F.lit(1)), 3)
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(lines), "\n").alias("sorted_text"), F.array_join(tail, "\n").alias("tail"))


@query("""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS hit, line_no FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents) WHERE contains(line, 'token')""")
def matching_lines(spark, sf):
    found = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.contains("line", F.lit("token")))
    hit = (F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no")) - 1).cast("long")
    return found.select("doc_id", hit.alias("hit"), F.col("line_no").cast("long").alias("line_no"))


@query("""SELECT vec_id, round(list_avg(e), 6) AS mean, round(list_stddev_pop(e), 6) AS sd, round(list_max(e), 6) AS most, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 5) AS length FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""")
def vector_statistics(spark, sf):
    e = F.transform("embedding", lambda x: x.cast("double"))
    v = table(spark, sf, "embeddings").select("vec_id", e.alias("e"))
    total = lambda f: F.aggregate("e", F.lit(0.0), lambda a, x: a + f(x))
    mean = total(lambda x: x) / F.size("e")
    return v.withColumn("m", mean).select("vec_id", r6(F.col("m")).alias("mean"), r6(F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + (x - F.col("m")) ** 2) / F.size("e"))).alias("sd"), r6(F.array_max("e")).alias("most"), F.round(F.sqrt(total(lambda x: x * x)), 5).alias("length"))


@query("""SELECT p_partkey AS k, ntile(16) OVER (ORDER BY p_partkey) AS chunk FROM part""")
def equal_chunks(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), F.ntile(16).over(Window.orderBy("p_partkey")).cast("long").alias("chunk"))


@query("""SELECT l_orderkey AS rollout, l_linenumber AS line, n_name AS nation, r_name AS region FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def dimension_lookups(spark, sf):
    places = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf, "supplier").join(F.broadcast(places), F.col("s_nationkey") == F.col("n_nationkey"))  # nations of the world: bounded
    return table(spark, sf, "lineitem").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_orderkey").alias("rollout"), F.col("l_linenumber").alias("line"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM documents), q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM benchmark),
tf AS (SELECT word, doc_id, count(*) AS tf FROM t GROUP BY ALL), dl AS (SELECT doc_id, sum(tf) AS dl FROM tf GROUP BY 1), s AS (SELECT count(*) AS n, avg(dl) AS mean FROM dl), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT tf.word, tf.doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean)) AS w FROM tf JOIN df USING (word) JOIN dl USING (doc_id), s),
r AS (SELECT item_id, doc_id, round(sum(w), 6) AS score FROM q JOIN w USING (word) GROUP BY ALL)
SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10""")
def lexical_top_ten(spark, sf):
    return R.lexical_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "doc_id", "item_id", "text").select("item_id", "doc_id", "score", "rank")


@query("""WITH c AS (SELECT o_orderkey AS rollout, (o_totalprice - avg(o_totalprice) OVER ()) * (o_custkey - avg(o_custkey) OVER ()) AS cov FROM orders) SELECT rollout FROM c ORDER BY cov DESC, rollout LIMIT 300""")
def top_covariance(spark, sf):
    r = rollouts(spark, sf)
    means = r.agg(F.avg("score").alias("ms"), F.avg("uid").alias("mu"))
    cov = (F.col("score") - F.col("ms")) * (F.col("uid") - F.col("mu"))
    return r.join(F.broadcast(means)).withColumn("cov", cov).orderBy(F.desc("cov"), "rollout").limit(300).select("rollout")


@query("""SELECT category, count(*) AS n, round(avg(p), 6) AS priority FROM (SELECT o_orderpriority AS category, 4 * (o_totalprice / 600000) * (1 - o_totalprice / 600000) AS p FROM orders) GROUP BY 1""")
def priorities_by_category(spark, sf):
    return rollouts(spark, sf).groupBy("category").agg(F.count("*").alias("n"), r6(F.avg(select.boundary_priority(F.col("score") / 600000))).alias("priority"))


@query("""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(q.e, v.e), 9) AS similarity FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, id, round(similarity, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS r FROM s) WHERE r <= 10""")
def nearest_vectors(spark, sf):
    """The query vectors are those whose number is divisible by 20, held against all others."""
    stored = table(spark, sf, "embeddings")
    return retrieval.nearest(stored, stored.where("vec_id % 20 = 0"), "vec_id", "embedding").select("query_id", "id", r6(F.col("similarity")).alias("similarity"))


@query("""SELECT doc_id, regexp_extract_all(text, '[0-9]+')[-1] AS last_number, len(string_split(text, ' ')) AS words FROM documents""")
def last_numbers(spark, sf):
    found = F.try_element_at(F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)), F.lit(-1))
    return table(spark, sf, "documents").select("doc_id", found.alias("last_number"), F.size(F.split("text", " ")).cast("long").alias("words"))
