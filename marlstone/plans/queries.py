"""Registered queries of the library's operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import protocol, scoring
from ..operators import advantage, gates, joins, select, sets, stats
from .tables import CODES_SQL, STEPS_SQL, coded_events, rollouts, steps, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


# --- advantages ---------------------------------------------------------------------------------------------


@query("""SELECT rollout, round(adv, 6) AS adv FROM (SELECT o_orderkey AS rollout, CASE WHEN count(*) OVER w = 1 THEN o_totalprice / (1 + 1e-6)
  ELSE (o_totalprice - avg(o_totalprice) OVER w) / (stddev_samp(o_totalprice) OVER w + 1e-6) END AS adv FROM orders WINDOW w AS (PARTITION BY o_custkey))""")
def advantage_group_normalised(spark, sf):
    return rollouts(spark, sf).select("rollout", F.round(advantage.group_normalised(F.col("score"), ["uid"]), 6).alias("adv"))


@query("""SELECT rollout, round(adv, 6) AS adv FROM (SELECT o_orderkey AS rollout, CASE WHEN count(*) OVER w = 1 THEN o_totalprice
  ELSE o_totalprice - avg(o_totalprice) OVER w END AS adv FROM orders WINDOW w AS (PARTITION BY o_custkey))""")
def advantage_group_centred(spark, sf):
    return rollouts(spark, sf).select("rollout", F.round(advantage.group_centred(F.col("score"), ["uid"]), 6).alias("adv"))


@query("""SELECT rollout, round(adv, 6) AS adv FROM (SELECT o_orderkey AS rollout, CASE WHEN count(*) OVER w > 1
  THEN (o_totalprice - avg(o_totalprice) OVER w) * count(*) OVER w / (count(*) OVER w - 1) ELSE o_totalprice END AS adv FROM orders WINDOW w AS (PARTITION BY o_custkey))""")
def advantage_leave_one_out(spark, sf):
    return rollouts(spark, sf).select("rollout", F.round(advantage.leave_one_out(F.col("score"), ["uid"]), 6).alias("adv"))


@query("""SELECT o_orderkey AS rollout, round(CASE WHEN count(*) OVER w > 1 THEN CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1
  THEN o_totalprice - nth_value(o_totalprice, 2) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE 0 END END, 6) AS adv
  FROM orders WINDOW w AS (PARTITION BY o_custkey)""")
def advantage_best_only(spark, sf):
    return rollouts(spark, sf).select("rollout", F.round(advantage.best_only(F.col("score"), [F.col("rollout")], ["uid"]), 6).alias("adv"))


@query(f"""WITH {STEPS_SQL}, o AS (SELECT o_orderkey AS rollout, o_custkey AS uid, o_totalprice AS score FROM orders), l AS (SELECT rollout, CAST(max(depth) + 1 AS DOUBLE) AS n FROM steps GROUP BY rollout),
j AS (SELECT o.*, l.n FROM o JOIN l USING (rollout))
SELECT rollout, round(CASE WHEN count(*) OVER w = 1 THEN score ELSE score - sum(n * score) OVER w / sum(n) OVER w END + 1e-7, 4) AS adv FROM j WINDOW w AS (PARTITION BY uid)""")
def advantage_length_weighted(spark, sf):
    lengths = steps(spark, sf).groupBy("rollout").agg((F.max("depth") + 1).cast("double").alias("n"))
    return rollouts(spark, sf).join(lengths, "rollout").select("rollout", F.round(advantage.length_weighted(F.col("score"), F.col("n"), ["uid"]) + 1e-7, 4).alias("adv"))


@query(f"""WITH {STEPS_SQL} SELECT rollout, depth, round(sum(reward) OVER (PARTITION BY rollout ORDER BY depth ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS to_go FROM steps""")
def reward_to_go(spark, sf):
    return steps(spark, sf).select("rollout", "depth", r6(advantage.reward_to_go(F.col("reward"), ["rollout"], ["depth"])).alias("to_go"))


@query(f"""WITH {STEPS_SQL} SELECT a.rollout, a.depth, round(sum(b.reward * power(0.9, b.depth - a.depth)), 10) AS discounted FROM steps a JOIN steps b ON a.rollout = b.rollout AND b.depth >= a.depth GROUP BY a.rollout, a.depth""")
def discounted_returns(spark, sf):
    found = advantage.discounted_returns(steps(spark, sf).select("rollout", "depth", "reward"), ["rollout"], ["depth"], "reward", 0.9)
    return found.select("rollout", "depth", F.round("discounted", 10).alias("discounted"))


@query(f"""WITH {STEPS_SQL}, d AS (SELECT rollout, depth, reward + coalesce(lead(length) OVER (PARTITION BY rollout ORDER BY depth), 0) - length AS delta FROM steps)
SELECT a.rollout, a.depth, round(sum(b.delta * power(0.95, b.depth - a.depth)), 9) AS advantage FROM d a JOIN d b ON a.rollout = b.rollout AND b.depth >= a.depth GROUP BY a.rollout, a.depth""")
def generalised_advantage(spark, sf):
    found = advantage.gae(steps(spark, sf).select("rollout", "depth", "reward", "length"), ["rollout"], ["depth"], "reward", "length")
    return found.select("rollout", "depth", F.round("advantage", 9).alias("advantage"))


@query(f"""WITH {STEPS_SQL}, s AS (SELECT o.o_custkey AS uid, s.* FROM steps s JOIN orders o ON o.o_orderkey = s.rollout)
SELECT rollout, depth, round(CASE WHEN count(*) OVER w >= 2 AND min(reward) OVER w <> max(reward) OVER w AND stddev_samp(reward) OVER w > 0 THEN (reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + 1e-6) ELSE 0 END, 5) + 0.0 AS adv FROM s WINDOW w AS (PARTITION BY uid, depth)""")
def ragged_depth_advantage(spark, sf):
    s = steps(spark, sf).join(rollouts(spark, sf).select("rollout", "uid"), "rollout")
    return s.select("rollout", "depth", (F.round(advantage.ragged_normalised(F.col("reward"), ["uid", "depth"]), 5) + F.lit(0.0)).alias("adv"))


@query("""WITH m AS (SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice AS v, CAST(l_returnflag = 'R' AS DOUBLE) AS m FROM lineitem), s AS (SELECT sum(m) AS c, sum(v * m) / (sum(m) + 1e-8) AS mean FROM m),
q AS (SELECT sum((v - mean) * (v - mean) * m) / (any_value(c) + 1e-8) * any_value(c) / (any_value(c) - 1) AS var, any_value(mean) AS mean FROM m, s)
SELECT k, n, round((v - mean) / sqrt(var + 1e-8), 5) AS whitened FROM m, q""")
def whitened_values(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("v"), (F.col("l_returnflag") == "R").alias("m"))
    return advantage.whitened(rows, "v", "m").select("k", "n", F.round("whitened", 5).alias("whitened"))


@query(f"""WITH {STEPS_SQL} SELECT rollout, depth, CASE WHEN coalesce(sum(CAST(flag = 'R' AS INT)) OVER (PARTITION BY rollout ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN 1 ELSE 0 END AS mask,
  CAST((sum(CAST(flag <> 'A' AS INT)) OVER (PARTITION BY rollout ORDER BY depth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1) * CAST(flag <> 'A' AS INT) AS BIGINT) AS position FROM steps""")
def end_mask_and_positions(spark, sf):
    s = steps(spark, sf)
    return s.select("rollout", "depth", advantage.first_end_mask(F.col("flag") == "R", ["rollout"], ["depth"]).alias("mask"), advantage.position_ids(F.col("flag") != "A", ["rollout"], ["depth"]).alias("position"))


@query(f"""WITH {CODES_SQL}, d AS (SELECT day, CAST(count(*) FILTER (code = 1) > 70 AS INT) AS score FROM coded GROUP BY day) SELECT max(day) AS last_step, count(*) FILTER (day > coalesce((SELECT max(day) FROM d WHERE score <> 0), DATE '0001-01-01')) AS trailing_zeros FROM d""")
def trailing_zero_updates(spark, sf):
    days = coded_events(spark, sf).groupBy("day").agg((F.count_if(F.col("code") == 1) > 70).cast("int").alias("score"))
    return advantage.trailing_zero_runs(days, "day", "score")


# --- statistics ---------------------------------------------------------------------------------------------


@query("""SELECT coalesce(category, 'overall') AS category, count(*) AS n, round(avg(score), 4) AS mean, round(max(score), 4) AS best, round(avg(CAST(score > 150000 AS DOUBLE)), 6) AS full_rate
FROM (SELECT o_orderpriority AS category, o_totalprice AS score FROM orders) GROUP BY GROUPING SETS ((), (category))""")
def two_level_report(spark, sf):
    m = {"n": F.count("*"), "mean": F.round(F.avg("score"), 4), "best": F.round(F.max("score"), 4), "full_rate": r6(F.avg((F.col("score") > 150000).cast("double")))}
    return stats.two_levels(rollouts(spark, sf), "category", m)


@query("""SELECT o_orderpriority AS category, round(quantile_cont(CAST(o_totalprice AS DOUBLE), 0.95), 4) AS p95, round(median(CAST(o_totalprice AS DOUBLE)), 4) AS p50,
  round(list_sort(list(o_totalprice))[CAST(round_even((count(*) - 1) * 0.95, 0) AS INT) + 1], 4) AS ranked95 FROM orders GROUP BY 1""")
def percentiles_by_category(spark, sf):
    s = F.col("score")
    return rollouts(spark, sf).groupBy("category").agg(F.round(stats.linear_percentile(s, 95), 4).alias("p95"), F.round(F.median(s), 4).alias("p50"), F.round(stats.rounded_rank_percentile(s, 0.95), 4).alias("ranked95"))


@query("""WITH c AS (SELECT user_id, event_type AS vote, count(*) AS votes, min(event_id) AS first, arg_min(value, event_id) AS value FROM events GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY votes DESC, first) AS n FROM c) SELECT user_id, vote, votes, round(value, 6) AS value FROM r WHERE n = 1""")
def majority_votes(spark, sf):
    found = stats.majority_vote(coded_events(spark, sf), ["user_id"], "event_type", "value", "event_id")
    return found.select("user_id", F.col("event_type").alias("vote"), "votes", r6(F.col("value")).alias("value"))


@query("""WITH m AS (SELECT 'max_price' AS metric, o_totalprice AS value FROM orders UNION ALL SELECT 'min_price', o_totalprice FROM orders UNION ALL SELECT 'price', o_totalprice FROM orders)
SELECT metric, round(CASE WHEN metric LIKE '%max%' THEN max(value) WHEN metric LIKE '%min%' THEN min(value) ELSE avg(value) END, 4) AS value FROM m GROUP BY metric""")
def reduced_metrics(spark, sf):
    s = rollouts(spark, sf)
    long = s.select(F.explode(F.array(*[F.lit(n) for n in ("max_price", "min_price", "price")])).alias("metric"), F.col("score").alias("value"))
    return stats.reduced_metrics(long, "metric", "value").select("metric", F.round("value", 4).alias("value"))


@query("""SELECT uid, n, round(CASE WHEN n < 2 THEN 0 ELSE variance / 1e6 END, 4) AS variance, all_zero, all_one FROM (SELECT o_custkey AS uid, count(*) AS n, var_pop(o_totalprice) AS variance, max(o_totalprice) = 0 AS all_zero, min(o_totalprice) = 1 AS all_one FROM orders GROUP BY 1)""")
def group_pass_rates(spark, sf):
    return stats.pass_rates(rollouts(spark, sf), ["uid"], F.col("score")).select("uid", "n", F.round(F.col("variance") / 1e6, 4).alias("variance"), "all_zero", "all_one")


@query("""WITH s AS (SELECT l_orderkey AS q, sum(l_extendedprice * (l_returnflag <> 'A')::INT) AS s, CAST(sum((l_returnflag <> 'A')::INT) AS DOUBLE) AS n FROM lineitem GROUP BY 1)
SELECT 'token-mean' AS mode, round(sum(s) / sum(n), 4) AS loss FROM s UNION ALL SELECT 'seq-mean-token-sum', round(avg(s), 4) FROM s
UNION ALL SELECT 'seq-mean-token-mean', round(avg(CASE WHEN n > 0 THEN s / n END), 4) FROM s UNION ALL SELECT 'seq-mean-token-sum-norm', round(sum(s) / 1000, 4) FROM s""")
def loss_modes(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("q"), F.col("l_extendedprice").alias("loss"), (F.col("l_returnflag") != "A").alias("m"))
    out = None
    for mode in ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm"):
        one = stats.loss_mean(rows, "q", "loss", "m", mode, 1000.0).select(F.lit(mode).alias("mode"), F.round("loss", 4).alias("loss"))
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT round(sum(l_discount * (l_tax > 0)::INT) / (sum((l_tax > 0)::INT) + 1e-8), 6) AS masked, round(sqrt(avg(l_discount * l_discount)), 6) AS rms, round(ln(avg(exp(5 * l_discount))) / 5, 6) AS soft FROM lineitem""")
def masked_moments(spark, sf):
    c = F.col("l_discount")
    return table(spark, sf, "lineitem").agg(r6(stats.masked_mean(c, F.col("l_tax") > 0)).alias("masked"), r6(stats.rms_or_zero(c)).alias("rms"), r6(stats.soft_mean(c, 5.0)).alias("soft"))


PER_SQL = "SELECT c_custkey AS uid, c_mktsegment AS segment, score FROM (SELECT o_custkey, avg(o_totalprice) AS score FROM orders GROUP BY 1) JOIN customer ON c_custkey = o_custkey"


@query(f"""SELECT segment, round(avg(score), 4) AS mean, true AS around, true AS wide FROM ({PER_SQL}) GROUP BY 1""")
def bootstrap_by_category(spark, sf):
    rows = _per_customer(spark, sf)
    found = stats.bootstrap_interval(rows, ["segment"], "score", "uid")
    # the interval is as wide as the mean's standard error says, within a quarter
    error = rows.groupBy("segment").agg((2 * 1.96 * F.stddev_samp("score") / F.sqrt(F.count("*"))).alias("_wide"))
    ratio = (F.col("upper") - F.col("lower")) / F.col("_wide")
    return found.join(error, "segment").select("segment", F.round("mean", 4).alias("mean"), F.col("mean").between(F.col("lower"), F.col("upper")).alias("around"), ratio.between(0.75, 1.25).alias("wide"))


@query("""WITH v AS (SELECT o_custkey AS uid, list(o_totalprice ORDER BY o_orderkey) AS v FROM orders GROUP BY 1), d AS (SELECT uid, v, d FROM v, range(40) t(d)),
p AS (SELECT uid, d, list_transform(range(4), lambda j: v[1 + (CAST('0x' || substr(md5('42:' || uid || ':' || d || ':' || j), 1, 8) AS BIGINT) % len(v))]) AS p FROM d)
SELECT uid, round(avg(list_max(p)), 6) AS best, round(stddev_pop(list_max(p)), 3) AS best_std, round(avg(list_max(p) - list_min(p)), 6) AS spread, round(stddev_pop(list_max(p) - list_min(p)), 3) AS spread_std FROM p GROUP BY 1""")
def bootstrapped_reducers(spark, sf):
    reducers = {"best": F.array_max, "spread": lambda x: F.array_max(x) - F.array_min(x)}
    found = stats.bootstrapped(rollouts(spark, sf), ["uid"], "score", "rollout", 4, reducers, draws=40)
    return found.select("uid", *[F.round(c, 3 if c.endswith("std") else 6).alias(c) for c in ("best", "best_std", "spread", "spread_std")])


def _per_customer(spark, sf):
    """One score for each customer, by market segment."""
    per = rollouts(spark, sf).groupBy("uid").agg(F.avg("score").alias("score"))
    return per.join(table(spark, sf, "customer").select(F.col("c_custkey").alias("uid"), F.col("c_mktsegment").alias("segment")), "uid")


@query(f"""WITH r AS (SELECT segment, score, row_number() OVER w AS i, count(*) OVER (PARTITION BY segment) AS c FROM ({PER_SQL}) WINDOW w AS (PARTITION BY segment ORDER BY score))
SELECT segment, CAST(n AS INTEGER) AS n, round(sum(score * (pow(i / c, n) - pow((i - 1) / c, n))), 2) AS best, round(sum(score * (pow((c - i + 1) / c, n) - pow((c - i) / c, n))), 2) AS worst FROM r, (VALUES (2), (4), (8)) t(n) GROUP BY 1, 2""")
def best_of_n_by_segment(spark, sf):
    found = stats.best_of_n(_per_customer(spark, sf), ["segment"], "score", [2, 4, 8])
    return found.select("segment", "n", F.round("best", 2).alias("best"), F.round("worst", 2).alias("worst"))


@query("""SELECT event_type, count(*) AS n, round(avg(CASE WHEN value > 50 THEN value END), 6) AS high_mean, count(DISTINCT user_id) AS users, round(avg(CAST(value > 50 AS DOUBLE)), 6) AS high_rate FROM events GROUP BY event_type""")
def conditional_rates(spark, sf):
    high = F.col("value") > 50
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), r6(F.avg(F.when(high, F.col("value")))).alias("high_mean"), F.countDistinct("user_id").alias("users"), r6(F.avg(high.cast("double"))).alias("high_rate"))


@query(f"""WITH {CODES_SQL} SELECT CASE WHEN day(day) <= 10 THEN 'early' WHEN day(day) <= 20 THEN 'middle' ELSE 'late' END AS region, count(*) AS n, round(avg(value), 4) AS mean FROM coded GROUP BY 1""")
def region_means(spark, sf):
    d = F.dayofmonth("day")
    return coded_events(spark, sf).groupBy(F.when(d <= 10, "early").when(d <= 20, "middle").otherwise("late").alias("region")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))


# --- rewards from codes -------------------------------------------------------------------------------------


@query(f"""WITH {CODES_SQL}, u AS (SELECT user_id, count(*) AS n, count(*) FILTER (code = 1) AS p, count(*) FILTER (code = 0) AS z, count(*) FILTER (code = -3) AS f, count(*) FILTER (code >= -1) AS ran, count(*) FILTER (code = -1) AS bad FROM coded GROUP BY user_id),
v AS (SELECT *, CASE WHEN p + z > 0 THEN p / (p + z)::DOUBLE ELSE 0 END AS progress, 1 - f / n::DOUBLE AS fr FROM u)
SELECT user_id, round(progress, 6) AS progress, round(fr, 6) AS format_rate, round(CASE WHEN ran > 0 THEN fr + (ran - bad) / ran::DOUBLE ELSE 0 END, 6) AS stage_one, round(4 * progress * (1 - progress), 6) AS priority,
  CASE WHEN progress < 0.2 THEN 'too_hard' WHEN progress <= 0.85 THEN 'boundary' ELSE 'mastered' END AS capability FROM v""")
def code_rewards(spark, sf):
    codes = coded_events(spark, sf).groupBy("user_id").agg(F.collect_list("code").alias("codes"))
    p = F.col("progress")
    scored = codes.withColumn("progress", scoring.progress(F.col("codes"))).withColumn("fr", scoring.format_rate(F.col("codes"))).withColumn("s1", scoring.stage_one_score(F.col("codes")))
    return scored.select("user_id", r6(p).alias("progress"), r6(F.col("fr")).alias("format_rate"), r6(F.col("s1")).alias("stage_one"), r6(select.boundary_priority(p)).alias("priority"), select.capability(p).alias("capability"))


@query(f"""WITH {CODES_SQL} SELECT code, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS percent FROM coded GROUP BY code""")
def code_histogram(spark, sf):
    n = coded_events(spark, sf).groupBy("code").agg(F.count("*").alias("n"))
    return n.select("code", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 4).alias("percent"))


@query("""WITH t AS (SELECT p_partkey AS k, (p_size - 25) / 10.0::DOUBLE AS x, p_retailprice / 1000 AS a FROM part)
SELECT k, round(x, 6) AS k1, round(x * x / 2, 6) AS k2, round(greatest(least(exp(-x) + x - 1, 10), -10), 6) AS k3, round(ln(1 + exp(-0.1 * x)), 6) AS dpo, round(greatest(-a * exp(x), -a * greatest(least(exp(x), 1.2), 0.8)), 6) AS clipped FROM t""")
def token_losses(spark, sf):
    t = table(spark, sf, "part").select(F.col("p_partkey").alias("k"), ((F.col("p_size") - 25) / F.lit(10.0)).alias("x"), (F.col("p_retailprice") / 1000).alias("a"))
    x, zero = F.col("x"), F.lit(0.0)
    return t.select("k", r6(scoring.kl_penalty(x, zero)).alias("k1"), r6(scoring.kl_penalty(x, zero, "k2")).alias("k2"), r6(scoring.kl_penalty(x, zero, "k3")).alias("k3"), r6(scoring.preference_loss(x)).alias("dpo"), r6(scoring.clipped_loss(F.exp(x), F.col("a"), dual=None)).alias("clipped"))


@query("""SELECT p_partkey AS k, round(CASE WHEN p_size < 10 THEN p_size / 10.0::DOUBLE ELSE 0.1 + 0.9 * (1 + cos(pi() * least((p_size - 10) / 40.0::DOUBLE, 1))) / 2 END, 6) AS rate, round(least(-(p_size - 30) / 10.0::DOUBLE, 0), 6) AS penalty, round(p_size * 9 / 5.0::DOUBLE + 32, 4) AS fahrenheit, round(p_size * 1609.344 / 1000, 4) AS km FROM part""")
def schedules_and_units(spark, sf):
    s = F.col("p_size")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("k"), r6(scoring.warmup_cosine(s, 10, 50, 0.1)).alias("rate"), r6(scoring.overlong_penalty(s, 40, 10)).alias("penalty"), F.round(scoring.converted(s.cast("double"), "c", "f"), 4).alias("fahrenheit"), F.round(scoring.converted(s.cast("double"), "mi", "km"), 4).alias("km"))


# --- joins --------------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT o_custkey AS uid, arg_max(o_totalprice, o_orderkey) AS a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), o AS (SELECT o_custkey AS uid, arg_max(o_totalprice, o_orderkey) AS b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT uid, round(a, 2) AS score_a, round(b, 2) AS score_b, round(b - a, 2) AS difference FROM f JOIN o USING (uid)""")
def paired_runs(spark, sf):
    s = rollouts(spark, sf)
    d = joins.paired_difference(s.where("status = 'F'"), s.where("status = 'O'"), "uid", "score", "rollout")
    return d.select("uid", *[F.round(c, 2).alias(c) for c in ("score_a", "score_b", "difference")])


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
SELECT a.o_custkey AS uid, a.o_orderkey AS winner, b.o_orderkey AS loser, round(a.o_totalprice - b.o_totalprice, 2) AS margin FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.n = 1 AND b.n = 2""")
def winner_loser(spark, sf):
    return joins.winner_loser(rollouts(spark, sf), "uid", "score", "rollout").withColumn("margin", F.round("margin", 2))


@query("""WITH o AS (SELECT o_custkey AS uid, o_orderkey AS i, o_totalprice AS a, CAST(o_orderkey * 7919 % 10007 AS DOUBLE) AS b FROM orders), p AS (SELECT x.uid, abs(x.a - y.a) AS gap, sign(x.a - y.a) = sign(x.b - y.b) AS same FROM o x JOIN o y ON x.uid = y.uid AND x.i < y.i)
SELECT uid, count(*) AS pairs, round(CASE WHEN sum(gap) > 0 THEN sum(CASE WHEN same THEN gap ELSE 0 END) / sum(gap) END, 6) AS agreement FROM p GROUP BY uid""")
def pair_agreement(spark, sf):
    s = rollouts(spark, sf).withColumn("b", F.pmod(F.col("rollout") * 7919, F.lit(10007)).cast("double"))
    return joins.pair_agreement(s, "uid", "rollout", "score", "b").withColumn("agreement", r6(F.col("agreement")))


@query("""SELECT e.event_id, e.user_id, s.event_id AS span_id FROM events e JOIN events s ON e.user_id = s.user_id AND s.event_type = 'purchase' AND epoch(e.ts) >= epoch(s.ts) AND epoch(e.ts) < epoch(s.ts) + 3600""")
def events_in_spans(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp").cast("double"))
    spans = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span_id"), F.col("at").alias("start"), (F.col("at") + 3600).alias("end"))
    return joins.in_spans(e.select("event_id", "user_id", "at"), spans, "user_id", "at", "start", "end", 3600).select("event_id", "user_id", "span_id")


@query("""SELECT event_id, round(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS latest FROM events""")
def latest_prior_purchase(spark, sf):
    e = table(spark, sf, "events")
    return joins.latest_prior(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("value")), "latest").select("event_id", r6(F.col("latest")).alias("latest"))


@query("""WITH w AS (SELECT o_custkey AS uid, o_orderpriority AS v, count(*) AS w FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL), g AS (SELECT o_custkey AS uid, o_orderpriority AS v, count(*) AS g FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL)
SELECT uid, v AS category, w - coalesce(g, 0) AS missing FROM w LEFT JOIN g USING (uid, v) WHERE w > coalesce(g, 0)""")
def multiset_containment(spark, sf):
    s = rollouts(spark, sf)
    return joins.multiset_missing(s.where("status = 'F'"), s.where("status = 'O'"), ["uid"], "category")


@query("""SELECT coalesce(a.k, b.k) AS uid, CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' ELSE 'both' END AS status FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P') b ON a.k = b.k""")
def reconciled_keys(spark, sf):
    s = rollouts(spark, sf)
    return joins.reconciled(s.where("status = 'F'"), s.where("status = 'P'"), "uid")


@query()
def optimal_call_assignment(spark, sf):
    """Calls of a turn matched to gold calls: lines of an order against its events-like targets, by closeness of discounts."""
    s = steps(spark, sf).select("rollout", "depth", "reward", "flag")
    gold = s.where("flag = 'R'").select("rollout", F.col("depth").alias("gold"), F.col("reward").alias("g"))
    pairs = s.where("flag <> 'R'").join(gold, "rollout").select("rollout", "depth", "gold", F.round(1 - 10 * F.abs(F.col("reward") - F.col("g")), 6).alias("similarity"))
    return joins.optimal_assignment(pairs, ["rollout"], "depth", "gold", "similarity").groupBy("rollout").agg(F.count("*").alias("matched"), F.round(F.sum("similarity"), 5).alias("total"))


# --- selection ----------------------------------------------------------------------------------------------


@query("""SELECT category, rollout, CAST(rank AS INT) AS rank FROM (SELECT o_orderpriority AS category, o_orderkey AS rollout, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 10""")
def ranked_quota(spark, sf):
    return select.ranked_quota(rollouts(spark, sf), "category", [F.desc("score"), F.asc("rollout")], 10).select("category", "rollout", "rank")


@query("""SELECT rollout, CAST(rank AS INT) AS rank FROM (SELECT o_orderpriority AS category, o_orderkey AS rollout, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 50 ORDER BY rank, category LIMIT 100""")
def interleaved_groups(spark, sf):
    return select.interleaved(rollouts(spark, sf), "category", [F.desc("score"), F.asc("rollout")], 50, 100).select("rollout", "rank")


@query("""SELECT o_orderkey AS rollout, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) % 2 AS INT) AS shard FROM orders""")
def even_odd_shards(spark, sf):
    return select.shard_by_rank(rollouts(spark, sf), "category", [F.asc("rollout")]).select("rollout", "shard")


@query("""WITH g AS (SELECT o_custkey, stddev_pop(o_totalprice) AS sd, count(*) AS n FROM orders GROUP BY 1) SELECT o_orderkey AS rollout FROM orders JOIN g USING (o_custkey) WHERE sd > 0 OR n = 1""")
def informative_groups(spark, sf):
    return select.informative_groups(rollouts(spark, sf), ["uid"], "score").select("rollout")


@query("""SELECT o_custkey AS uid, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS rollout FROM orders GROUP BY 1""")
def first_seen_rows(spark, sf):
    return select.first_seen(rollouts(spark, sf), "uid", [F.asc("at"), F.asc("rollout")]).select("uid", "rollout")


@query("""SELECT o_orderkey AS rollout FROM orders WHERE o_totalprice IS NOT NULL ORDER BY o_totalprice, o_orderkey LIMIT 100""")
def evicted_rows(spark, sf):
    return select.evicted(rollouts(spark, sf), "score", [F.asc("rollout")], 100).select("rollout")


@query("""SELECT category, count(*) AS n FROM (SELECT o_orderpriority AS category, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r FROM orders) WHERE r <= 25 GROUP BY 1""")
def stratified_counts(spark, sf):
    return select.stratified_sample(rollouts(spark, sf), "category", "rollout", 25).groupBy("category").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS rollout, CAST(floor((n - 1) / 64) AS INT) AS batch FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS n, count(*) OVER (PARTITION BY o_orderpriority) AS c FROM orders) WHERE floor((n - 1) / 64) < floor(c / 64)""")
def minibatch_numbers(spark, sf):
    return select.minibatches(rollouts(spark, sf), ["rollout"], 64, "category").select("rollout", "batch")


@query("""SELECT l_suppkey AS batch, count(*) AS items, sum(l_quantity)::BIGINT AS total, 0::BIGINT AS overfull, true AS few FROM lineitem GROUP BY 1""")
def packed_bins(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("batch"), F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate").alias("item"), "l_quantity")
    bins = select.packed(rows, ["batch"], "item", "l_quantity", 64).groupBy("batch", "bin").agg(F.count("*").alias("n"), F.max("load").alias("load"))
    # two bins of best fit always exceed the cap together, so there are at most twice as many as needed
    found = bins.groupBy("batch").agg(F.sum("n").alias("items"), F.sum("load").alias("total"), F.count_if(F.col("load") > 64).alias("overfull"), F.count("*").alias("_bins"))
    return found.withColumn("few", F.col("_bins") <= 2 * F.ceil(F.col("total") / 64)).drop("_bins")


@query("""SELECT l_suppkey AS batch, least(8, count(*))::BIGINT AS parts, count(*) AS items, sum(l_quantity)::BIGINT AS total, true AS alike FROM lineitem GROUP BY 1""")
def balanced_parts(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("batch"), F.monotonically_increasing_id().alias("item"), F.col("l_quantity").cast("long").alias("n"))
    parts = select.balanced(rows.select("batch", F.struct("item", "n").alias("item"), "n"), ["batch"], "item", "n", 8)
    loads = parts.groupBy("batch", "part").agg(F.count("*").alias("items"), F.sum("item.n").alias("load"))
    found = loads.groupBy("batch").agg(F.count("*").alias("parts"), F.sum("items").alias("items"), F.sum("load").alias("total"), F.max("load").alias("_hi"), F.min("load").alias("_lo"))
    return found.withColumn("alike", F.col("_hi") - F.col("_lo") <= 50).drop("_hi", "_lo")  # the longest item


# --- sets and gates -----------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT md5(text) AS h, min(doc_id) AS first FROM documents GROUP BY 1) SELECT doc_id, CASE WHEN doc_id <> first THEN first END AS duplicate_of FROM documents JOIN f ON md5(text) = h""")
def duplicates_with_pointers(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"))
    return sets.duplicates_routed(rows, ["h"], ["doc_id"], "doc_id").select("doc_id", "duplicate_of")


@query("""SELECT c_custkey AS uid, CAST((CASE WHEN f THEN 1 ELSE 0 END) + (CASE WHEN o THEN 1 ELSE 0 END) AS BIGINT) AS n_parts, f <> o AS ok FROM (SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F') AS f, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') AS o FROM customer)""")
def split_partition_check(spark, sf):
    s = rollouts(spark, sf)
    whole = table(spark, sf, "customer").select(F.col("c_custkey").alias("uid"))
    return sets.split_check(whole, {"f": s.where("status = 'F'"), "o": s.where("status = 'O'")}, "uid")


@query("""WITH a AS (SELECT o_custkey AS v, count(*) AS n_a FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS v, count(*) AS n_b FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
SELECT coalesce(a.v, b.v) AS uid, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM a FULL JOIN b ON a.v = b.v WHERE coalesce(n_a, 0) <> coalesce(n_b, 0)""")
def multiset_differences(spark, sf):
    s = rollouts(spark, sf)
    return sets.multiset_difference(s.where("status = 'F'"), s.where("status = 'O'"), "uid")


@query("""WITH j AS (SELECT o_orderkey AS rollout, list_filter(['priced', 'final', 'urgent'], lambda x: (x = 'priced' AND NOT o_totalprice > 1000) OR (x = 'final' AND NOT o_orderstatus = 'F') OR (x = 'urgent' AND NOT starts_with(o_orderpriority, '1'))) AS f FROM orders)
SELECT rollout, array_to_string(f, ',') AS failures, len(f) = 0 AS passed FROM j""")
def record_gates(spark, sf):
    rules = {"priced": F.col("score") > 1000, "final": F.col("status") == "F", "urgent": F.col("category").startswith("1")}
    return gates.gated(rollouts(spark, sf), rules).select("rollout", F.array_join("failures", ",").alias("failures"), "passed")


@query("""WITH m AS (SELECT o_custkey AS uid, o_orderkey, o_orderdate, max(o_orderdate) OVER (PARTITION BY o_custkey) AS best FROM orders) SELECT uid, min(o_orderkey) AS rollout, count(*) AS ties, count(*) = 1 AS resolved FROM m WHERE o_orderdate = best GROUP BY uid""")
def unique_latest(spark, sf):
    return gates.unique_extremum(rollouts(spark, sf), ["uid"], "at", "rollout")


@query("""WITH g AS (SELECT l_orderkey AS rollout, min(l_linenumber) AS a, max(l_linenumber) AS b, count(*) AS n, count(DISTINCT l_linenumber) AS d FROM lineitem GROUP BY 1) SELECT l.l_orderkey AS rollout, l.l_linenumber - 1 AS line FROM lineitem l JOIN g ON g.rollout = l.l_orderkey WHERE a = 1 AND b = n AND d = n""")
def contiguous_turns(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rollout"), (F.col("l_linenumber") - 1).alias("line"))
    return gates.contiguous(rows, ["rollout"], "line")


# --- text and protocol --------------------------------------------------------------------------------------


@query("""SELECT conv_id, turn, array_to_string(list_filter(string_split_regex(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'), lambda x: x NOT IN ('a', 'an', 'the', '')), ' ') AS normal FROM conversations""")
def normal_answers(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", protocol.normal_answer(F.col("text")).alias("normal"))


@query("""WITH c AS (SELECT conv_id, turn, role, CAST(role <> coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn, text), '') AS INT) AS new FROM conversations),
r AS (SELECT conv_id, role, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT role, count(*) AS runs FROM (SELECT DISTINCT conv_id, role, run FROM r) GROUP BY role""")
def role_runs(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    c = table(spark, sf, "conversations").withColumn("new", (F.col("role") != F.coalesce(F.lag("role").over(w), F.lit(""))).cast("int"))
    r = c.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return r.select("conv_id", "role", "run").distinct().groupBy("role").agg(F.count("*").alias("runs"))


@query("""SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events""")
def json_payload(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT doc_id, len(string_split(text, chr(10))) AS lines, length(text) AS chars, sha256(text) AS digest FROM documents""")
def text_counts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("lines"), F.length("text").cast("long").alias("chars"), F.sha2("text", 256).alias("digest"))


@query("""SELECT conv_id, list_count(string_agg_roles) AS turns FROM (SELECT conv_id, list(role) AS string_agg_roles FROM conversations GROUP BY conv_id)""")
def conversation_turns(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("role").alias("turns"))
