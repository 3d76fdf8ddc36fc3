"""Registered queries of reports and step credit."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import credit as C
from ..operators import reports as R
from .queries import query, r6
from .tables import CODES_SQL, STEPS_SQL, coded_events, rollouts, steps, table


def rounded(df, digits=6):
    """Doubles rounded, so that the order of partial sums doesn't show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("""SELECT round(avg(l_extendedprice), 4) AS l_extendedprice_mean, round(max(l_extendedprice), 4) AS l_extendedprice_max, round(min(l_extendedprice), 4) AS l_extendedprice_min, round(avg(l_tax), 4) AS l_tax_mean, round(max(l_tax), 4) AS l_tax_max, round(min(l_tax), 4) AS l_tax_min,
round(avg(CAST(l_quantity = 50 AS DOUBLE)), 4) AS clip_ratio, round(1 - var_samp(l_tax - l_discount) / var_samp(l_tax), 4) AS explained_variance FROM lineitem""")
def batch_metrics(spark, sf):
    return rounded(R.metric_block(table(spark, sf, "lineitem"), ["l_extendedprice", "l_tax"], "l_quantity", 50.0, "l_tax", "l_discount"), 4)


@query("""SELECT event_type, round(sum(value), 4) AS seconds, round(sum(value) * 1000 / sum(CASE WHEN event_type = 'click' THEN user_id % 7 + 1 ELSE user_id + 1 END), 4) AS ms_per_token FROM events GROUP BY 1""")
def stage_timings(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "value", (F.col("user_id") % 7 + 1).alias("answer"), (F.col("user_id") + 1).alias("whole"))
    return rounded(R.stage_timings(rows, "event_type", "value", "answer", "whole", ["click"]), 4)


@query("""SELECT sum(n_chars)::BIGINT AS tokens, round(sum(n_chars) / (12.5 * 8), 4) AS throughput FROM documents""")
def token_throughput(spark, sf):
    return rounded(R.throughput(table(spark, sf, "documents"), "n_chars", 12.5, 8), 4)


@query("""SELECT category, round(avg(m), 4) AS score, count(*) AS prompts FROM (SELECT o_orderpriority AS category, o_custkey, avg(o_totalprice) AS m FROM orders GROUP BY 1, 2) GROUP BY 1""")
def mean_of_prompt_means(spark, sf):
    return rounded(R.mean_of_means(rollouts(spark, sf), "category", "uid", "score"), 4)


@query("""WITH r AS (SELECT o_orderstatus AS category, o_custkey AS uid, o_totalprice / 1000 AS v, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_orderstatus, o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_orderstatus, o_custkey ORDER BY o_totalprice)),
e AS (SELECT *, unnest(list_append(list_filter([2, 4, 8, 16, 32, 64, 128, 256, 512, 1024], lambda k: k < n), n)) AS k FROM r WHERE n > 1),
d AS (SELECT category, uid, k, sum(v * ((i / n) ** k - ((i - 1) / n) ** k)) AS b, sum(v * v * ((i / n) ** k - ((i - 1) / n) ** k)) AS b2, sum(v * (((n - i + 1) / n) ** k - ((n - i) / n) ** k)) AS w, sum(v * v * (((n - i + 1) / n) ** k - ((n - i) / n) ** k)) AS w2 FROM e GROUP BY 1, 2, 3),
m AS (SELECT category, uid, 'best@' || k || '/mean' AS metric, b AS value FROM d UNION ALL SELECT category, uid, 'best@' || k || '/std', sqrt(greatest(b2 - b * b, 0)) FROM d UNION ALL SELECT category, uid, 'worst@' || k || '/mean', w FROM d UNION ALL SELECT category, uid, 'worst@' || k || '/std', sqrt(greatest(w2 - w * w, 0)) FROM d
UNION ALL SELECT category, uid, 'mean@' || count(*), avg(v) FROM r GROUP BY 1, 2 UNION ALL SELECT category, uid, 'std@' || count(*), stddev_pop(v) FROM r GROUP BY 1, 2 HAVING count(*) > 1)
SELECT category, metric, round(avg(value), 3) AS value FROM m GROUP BY 1, 2""")
def validation_metrics(spark, sf):
    rows = rollouts(spark, sf).select(F.col("status").alias("category"), "uid", (F.col("score") / 1000).alias("v"))
    return rounded(R.validation_metrics(rows, "category", "uid", "v"), 3)


@query(f"""WITH {CODES_SQL} SELECT event_type, day, count(*) AS rows, round(avg(value), 6) AS mean_value, round(avg(code), 6) AS mean_code, count(*) FILTER (code = -3) AS "count_-3", count(*) FILTER (code = 1) AS count_1 FROM coded GROUP BY 1, 2""")
def aggregates_with_counters(spark, sf):
    return rounded(R.aggregate_with_counters(coded_events(spark, sf), ["event_type", "day"], ["value", "code"], "code", [-3, 1]))


@query("""SELECT o_custkey AS uid, round(f, 6) AS F, round(o, 6) AS O, round(p, 6) AS P, round(o - f, 6) AS F_to_O, round(p - f, 6) AS F_to_P, round(p - o, 6) AS O_to_P
FROM (SELECT o_custkey, avg(o_totalprice) FILTER (o_orderstatus = 'F') AS f, avg(o_totalprice) FILTER (o_orderstatus = 'O') AS o, avg(o_totalprice) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1)""")
def compared_models(spark, sf):
    return rounded(R.compared(rollouts(spark, sf), "uid", "status", ["F", "O", "P"], "score"), 6)


@query("""WITH e AS (SELECT day(ts) AS step, CASE WHEN event_type <> 'error' THEN value END AS m FROM events WHERE day(ts) % 9 <> 4)
SELECT s.step, count(e.step) AS rows, round(avg(CASE WHEN e.step IS NOT NULL THEN coalesce(m, 0) END), 6) AS mean FROM range(1, 32) s(step) LEFT JOIN e USING (step) GROUP BY 1""")
def means_by_step(spark, sf):
    rows = table(spark, sf, "events").select(F.dayofmonth("ts").alias("step"), F.when(F.col("event_type") != "error", F.col("value")).alias("m")).where("step % 9 != 4")
    return rounded(R.step_means(rows, "step", ["m"], 31))


@query("""WITH e AS (SELECT day(ts) AS step, CASE WHEN event_type = 'click' THEN value END AS a, CASE WHEN event_type <> 'error' THEN -value END AS b FROM events)
SELECT s.step, count(e.step) AS rows, round(avg(CASE WHEN e.step IS NOT NULL THEN coalesce(a, b, 0) END), 6) AS mean FROM range(1, 32) s(step) LEFT JOIN e USING (step) GROUP BY 1""")
def means_by_step_with_fallback(spark, sf):
    rows = table(spark, sf, "events").select(F.dayofmonth("ts").alias("step"), F.when(F.col("event_type") == "click", F.col("value")).alias("a"), F.when(F.col("event_type") != "error", -F.col("value")).alias("b"))
    return rounded(R.step_means(rows, "step", ["a", "b"], 31))


@query("""SELECT user_id % 4 AS device, round(max(value), 6) AS peak_value, round(avg(value), 6) AS mean_value, min(ts) AS first, max(ts) AS last, round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 3) AS seconds FROM events GROUP BY 1""")
def device_peaks(spark, sf):
    out = R.device_peaks(table(spark, sf, "events"), F.col("user_id") % 4, "ts", ["value"])
    return out.select("device", r6(F.col("peak_value")).alias("peak_value"), r6(F.col("mean_value")).alias("mean_value"), "first", "last", F.round("seconds", 3).alias("seconds"))


@query("""SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS rate FROM lineitem""")
def weighted_rate(spark, sf):
    return rounded(R.weighted_rate(table(spark, sf, "lineitem"), F.col("l_discount"), F.col("l_quantity")))


@query("""SELECT round(avg(o_totalprice), 3) AS mean, max(o_totalprice) AS max, min(o_totalprice) AS min, round(stddev_samp(o_totalprice), 3) AS std, round(sum(o_totalprice) FILTER (o_orderstatus = 'F') / (count(*) FILTER (o_orderstatus = 'F') + 1e-8), 3) AS masked_mean FROM orders""")
def global_moments(spark, sf):
    return rounded(R.global_moments(rollouts(spark, sf), "score", (F.col("status") == "F").cast("double")), 3)


@query("""WITH a AS (SELECT p_size % 7 AS k, sum(p_size) AS s FROM part GROUP BY 1), b AS (SELECT p_partkey % 7 AS k, sum(p_size) AS s FROM part GROUP BY 1)
SELECT (SELECT min(s) FROM a)::BIGINT AS min, (SELECT max(s) FROM a)::BIGINT AS max, (SELECT max(s) - min(s) FROM a)::BIGINT AS diff, (SELECT round(avg(s), 6) FROM a) AS mean, (SELECT min(s) FROM b)::BIGINT AS balanced_min, (SELECT max(s) FROM b)::BIGINT AS balanced_max, (SELECT max(s) - min(s) FROM b)::BIGINT AS balanced_diff""")
def length_imbalance(spark, sf):
    rows = table(spark, sf, "part").select("p_size", (F.col("p_size") % 7).alias("a"), (F.col("p_partkey") % 7).alias("b"))
    return rounded(R.imbalance(rows, "p_size", "a", "b"))


@query("""SELECT n.event_type, count(e.event_id) AS count, round(coalesce(sum(value), 0), 4) AS latency_sum, round(coalesce(avg(value), 0), 4) AS latency_mean FROM (VALUES ('click'), ('error'), ('timeout'), ('view')) n(event_type) LEFT JOIN events e USING (event_type) GROUP BY 1""")
def zero_filled_counters(spark, sf):
    return rounded(R.zero_filled(table(spark, sf, "events"), "event_type", ["click", "error", "timeout", "view"], "value"), 4)


@query("""WITH s AS (SELECT source, lang, sum(n_chars)::BIGINT AS size FROM documents GROUP BY ROLLUP (source, lang))
SELECT source, lang, size, CASE WHEN size < 1024 THEN printf('%.2f B', size::DOUBLE) WHEN size < 1048576 THEN printf('%.2f KB', size / 1024) WHEN size < 1073741824 THEN printf('%.2f MB', size / 1048576) ELSE printf('%.2f GB', size / 1073741824) END AS human FROM s""")
def sizes_by_path(spark, sf):
    return R.sizes_by_path(table(spark, sf, "documents"), ["source", "lang"], "n_chars")


@query("""SELECT l_suppkey, count(*) AS messages, count(DISTINCT l_partkey) AS others FROM lineitem GROUP BY 1""")
def inbox_statistics(spark, sf):
    return R.inbox(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


@query("""SELECT user_id, count(*) FILTER (event_type = 'view') AS views, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (value > 50) AS large FROM events GROUP BY 1""")
def user_statistics(spark, sf):
    return R.conditional_counts(table(spark, sf, "events"), "user_id", {"views": F.col("event_type") == "view", "clicks": F.col("event_type") == "click", "large": F.col("value") > 50})


@query("""SELECT lang, source, count(*) AS rows, count(DISTINCT doc_id) AS ids, count(*) FILTER (NOT (text IS NOT NULL AND length(text) >= 100)) AS errors FROM documents GROUP BY 1, 2""")
def dataset_audit(spark, sf):
    return R.audit(table(spark, sf, "documents"), "lang", "source", "doc_id", F.col("text").isNotNull() & (F.length("text") >= 100))


@query("""SELECT o_orderstatus AS status, missing, count(*) AS entries FROM (SELECT o_orderstatus, o_custkey, count(*) FILTER (o_totalprice < 100000) AS missing FROM orders GROUP BY 1, 2) GROUP BY 1, 2""")
def missing_turn_cardinality(spark, sf):
    return R.cardinality(rollouts(spark, sf), "status", "uid", F.col("score") < 100000)


@query(f"""WITH {CODES_SQL}, c AS (SELECT user_id, day, max(CAST(code = 1 AS INT)) AS c FROM coded GROUP BY 1, 2) SELECT round(avg(CAST(code = -3 AS DOUBLE)), 6) AS "ratio_-3", round(avg(CAST(code = 1 AS DOUBLE)), 6) AS ratio_1, (SELECT round(avg(c), 6) FROM c) AS closure_rate FROM coded""")
def code_ratios(spark, sf):
    return rounded(R.code_ratios(coded_events(spark, sf), "code", [-3, 1], ["user_id", "day"], F.col("code") == 1))


@query("""WITH e AS (SELECT o_custkey, max(CAST(o_orderstatus = 'P' AS INT)) AS d FROM orders GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (d = 0) AS succeeded, count(*) FILTER (d = 1) AS dropped, count(*) FILTER (d IS NULL) AS pending FROM customer LEFT JOIN e ON c_custkey = o_custkey""")
def queue_depth(spark, sf):
    seeds = table(spark, sf, "customer").select(F.col("c_custkey").alias("uid"))
    return R.queue_depth(seeds, rollouts(spark, sf), "uid", F.col("status") == "P")


@query("""SELECT round((6.0 * 7e9 * sum(n_chars) + 12.0 * 28 * 28 * 128 * sum(n_chars::DOUBLE * n_chars)) / 60 / 1e12, 3) AS tflops FROM documents""")
def achieved_flops(spark, sf):
    return rounded(R.flops(table(spark, sf, "documents"), "n_chars", 60.0, 7_000_000_000, 28, 28, 128), 3)


@query("""SELECT round(c_acctbal, 2)::DOUBLE AS c_acctbal, 0.0::DOUBLE AS absent FROM customer""")
def zero_filled_metrics(spark, sf):
    return R.zero_schema(table(spark, sf, "customer"), ["c_acctbal", "absent"]).select(F.round("c_acctbal", 2).alias("c_acctbal"), "absent")


@query("""SELECT l_returnflag, round(avg(l_tax), 6) AS mean_l_tax, round(avg(l_discount), 6) AS mean_l_discount, round(avg(l_quantity), 6) AS length_mean, max(l_quantity) AS length_max FROM lineitem GROUP BY 1""")
def checkpoint_means(spark, sf):
    return rounded(R.checkpoint_means(table(spark, sf, "lineitem"), "l_returnflag", ["l_tax", "l_discount"], "l_quantity"))


@query("""SELECT o_orderpriority AS category, count(*) AS episodes, round(100 * avg(o_totalprice / 500000), 4) AS progress_percent, round(100 * avg(CAST(o_orderstatus = 'F' AS DOUBLE)), 4) AS accuracy FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())""")
def evaluation_report(spark, sf):
    return rounded(R.evaluation(rollouts(spark, sf), "category", F.col("score") / 500000, F.col("status") == "F"), 4)


@query(f"""WITH {CODES_SQL}, s AS (SELECT user_id, list(CASE code WHEN 1 THEN 1.0 WHEN -3 THEN -1.0 ELSE 0.0 END) AS s FROM coded GROUP BY 1) SELECT user_id, round(list_sum(list_transform(s, lambda x: greatest(x, 0.0)))::DOUBLE / len(s), 6) AS score FROM s""")
def overall_scores(spark, sf):
    turn = F.when(F.col("code") == 1, 1.0).when(F.col("code") == -3, -1.0).otherwise(0.0)
    turns = coded_events(spark, sf).groupBy("user_id").agg(F.collect_list(turn).alias("s"))
    return turns.select("user_id", r6(R.overall_score(F.col("s"))).alias("score"))


@query(f"""WITH {STEPS_SQL}, n AS (SELECT *, count(*) OVER g AS n, avg(reward) OVER g AS m, avg(length) OVER g AS q FROM steps WINDOW g AS (PARTITION BY rollout)),
r AS (SELECT *, CASE WHEN n > 1 THEN (reward - m) * n / (n - 1) ELSE reward END * 1.0 + CASE WHEN n > 1 THEN (length - q) * n / (n - 1) ELSE length END * 0.5 AS r FROM n),
g AS (SELECT *, sum(r) OVER (PARTITION BY rollout ORDER BY depth DESC) AS g FROM r)
SELECT rollout, depth::INT AS depth, round((g - (SELECT avg(g) FROM g)) / sqrt((SELECT var_samp(g) FROM g) + 1e-8), 4) AS advantage FROM g""")
def multi_source_advantage(spark, sf):
    out = C.multi_source(steps(spark, sf), ["rollout"], ["rollout"], ["depth"], {"reward": 1.0, "length": 0.5})
    return out.select("rollout", F.col("depth").cast("int").alias("depth"), F.round("advantage", 4).alias("advantage"))


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, round(l_tax + CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 0.5 * l_discount ELSE 0 END, 6) AS advantage FROM lineitem""")
def fused_advantage(spark, sf):
    out = C.fused(F.col("l_tax"), F.col("l_discount"), 0.5, F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", r6(out).alias("advantage"))


@query("""WITH g AS (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING min(l_linenumber) = 1 AND max(l_linenumber) = count(*) AND count(DISTINCT l_linenumber) = count(*)) SELECT l_orderkey, l_linenumber FROM lineitem JOIN g USING (l_orderkey)""")
def contiguous_turn_rows(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("j", F.col("l_linenumber") - 1)
    return C.contiguous_turns(rows, ["l_orderkey"], "j").select("l_orderkey", "l_linenumber")


@query(f"""WITH {CODES_SQL}, g AS (SELECT user_id, day, count(*) FILTER (code = 1) AS a, max(CASE WHEN code = 1 THEN event_id END) AS found, max(event_id) AS z FROM coded GROUP BY 1, 2) SELECT user_id, event_id FROM coded JOIN g USING (user_id, day) WHERE (a = 0 OR (a = 1 AND found = z)) AND code IS DISTINCT FROM 1""")
def rows_before_answers(spark, sf):
    return C.before_answer(coded_events(spark, sf), ["user_id", "day"], "event_id", F.col("code") == 1).select("user_id", "event_id")


@query(f"""WITH {CODES_SQL}, g AS (SELECT user_id, day, count(*) FILTER (code = 1) AS a, max(CASE WHEN code = 1 THEN event_id END) AS found, max(event_id) AS z FROM coded GROUP BY 1, 2) SELECT count(*) AS groups, count(*) FILTER (NOT (a = 0 OR (a = 1 AND found = z))) AS dropped FROM g""")
def misplaced_answers(spark, sf):
    return C.misplaced_answers(coded_events(spark, sf), ["user_id", "day"], "event_id", F.col("code") == 1)


@query(f"""WITH {CODES_SQL} SELECT user_id, event_id, coalesce(lag(code = -1) OVER (PARTITION BY user_id ORDER BY event_id), false) AS follows FROM coded""")
def follows_missing_turn(spark, sf):
    return C.follows(coded_events(spark, sf), ["user_id"], ["event_id"], F.col("code") == -1).select("user_id", "event_id", "follows")


@query("""WITH e AS (SELECT user_id, value / 100 AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), t AS (SELECT user_id, count(*) AS observations, max(value) FILTER (k = 3) AS trial, max_by(value, k) AS last FROM e GROUP BY 1)
SELECT user_id, observations, round(trial, 6) AS trial, round(last, 6) AS last, CASE WHEN trial < 0.2 THEN 'trial_too_hard' WHEN last < 0.2 THEN 'drift_too_hard' WHEN last > 0.85 THEN 'mastered' END AS reason FROM t""")
def retired_candidates(spark, sf):
    out = C.trial_and_last(table(spark, sf, "events").withColumn("value", F.col("value") / 100), "user_id", ["event_id"], "value", 3)
    return out.select("user_id", "observations", r6(F.col("trial")).alias("trial"), r6(F.col("last")).alias("last"), C.retirement(F.col("trial"), F.col("last"), 0.2, 0.85).alias("reason"))


@query("""WITH g AS (SELECT o_custkey AS uid, avg(o_totalprice) BETWEEN 150000 AND 250000 AND NOT bool_or(o_orderstatus = 'P') AS passed FROM orders GROUP BY 1) SELECT uid, passed FROM g ORDER BY passed DESC, uid LIMIT (SELECT (count(*) // 4) FROM g)""")
def banded_groups(spark, sf):
    return C.banded_groups(rollouts(spark, sf), "uid", "score", F.col("status") == "P", 150000, 250000, 4)


@query(f"""WITH {STEPS_SQL}, g AS (SELECT *, sum(reward) OVER (PARTITION BY rollout ORDER BY depth DESC) AS g FROM steps) SELECT rollout, depth::INT AS depth, round(reward / (SELECT max(abs(g)) FROM g), 6) AS scaled FROM g""")
def scaled_rewards(spark, sf):
    return C.scaled_by_largest(steps(spark, sf), ["rollout"], ["depth"], "reward").select("rollout", F.col("depth").cast("int").alias("depth"), r6(F.col("scaled")).alias("scaled"))


@query("""SELECT o_orderkey AS rollout FROM orders WHERE o_totalprice > 100000 AND o_totalprice < 300000 ORDER BY md5('7:' || o_orderkey), o_orderkey LIMIT greatest(1, (SELECT count(*) // 50 FROM orders))""")
def drawn_from_band(spark, sf):
    return C.drawn_from_band(rollouts(spark, sf), F.col("score"), 100000, 300000, 0.02, "rollout", 7).select("rollout")


@query("""SELECT c_custkey FROM customer ORDER BY md5('42:' || c_custkey), c_custkey""")
def shuffled_rows(spark, sf):
    return C.shuffled(table(spark, sf, "customer"), "c_custkey", 42).select("c_custkey")


@query("""WITH w AS (SELECT c_mktsegment AS g, c_custkey AS item, c_acctbal + 1000.0 AS w FROM customer), e AS (SELECT *, sum(w) OVER (PARTITION BY g ORDER BY item) / sum(w) OVER (PARTITION BY g) AS b FROM w),
f AS (SELECT g, item, coalesce(lag(b) OVER (PARTITION BY g ORDER BY item), 0) AS a, CASE WHEN row_number() OVER (PARTITION BY g ORDER BY item DESC) = 1 THEN 1 ELSE b END AS b FROM e),
d AS (SELECT g, draw, CAST('0x' || substr(md5('5:' || g || ':' || draw), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM (SELECT DISTINCT g FROM w), range(200) t(draw))
SELECT g, draw::INT AS draw, item FROM d JOIN f USING (g) WHERE u >= a AND u < b""")
def resampled_rows(spark, sf):
    rows = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_custkey").alias("item"), "c_acctbal")
    return C.resampled(rows, ["g"], "item", F.col("c_acctbal") + 1000.0, 200, 5)


@query("""WITH a AS (SELECT p_partkey, p_retailprice::DOUBLE AS v FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 1), b AS (SELECT p_partkey, p_size::DOUBLE AS v FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM a) ORDER BY p_size DESC, p_partkey LIMIT 1)
SELECT 'p_retailprice' AS dimension, p_partkey, v AS value FROM a UNION ALL SELECT 'p_size', p_partkey, v FROM b""")
def best_per_dimension(spark, sf):
    return C.best_per_dimension(table(spark, sf, "part"), "p_partkey", ["p_retailprice", "p_size"])


@query("""WITH r AS (SELECT o_orderpriority AS category, o_orderkey AS rollout, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT category, rollout FROM r WHERE k = n // 2 + 1""")
def middle_rows(spark, sf):
    return C.middle(rollouts(spark, sf), ["category"], ["score", "rollout"]).select("category", "rollout")
