"""Registered queries of the metric blocks: orders are rollouts of a customer, their lines are steps of turns of three."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from .queries import query
from .tables import STEPS_SQL, rollouts, steps, table

WEIGHT = 0.3
QUOTAS = {"1-URGENT": 40, "2-HIGH": 1000000, "3-MEDIUM": 3, "5-LOW": 0}

SETS_SQL = f"""{STEPS_SQL}, rolls AS (SELECT o_orderkey AS rollout, o_custkey AS uid, o_orderpriority AS kind, o_totalprice / 100000 - 1 AS a, CAST(o_orderkey % 50 + 20 AS DOUBLE) AS tokens, o_orderkey % 4 AS gold, o_orderstatus <> 'P' AS reliable FROM orders),
s AS (SELECT uid, rollout, depth // 3 AS turn, depth % 3 AS depth, kind, a, CASE flag WHEN 'N' THEN 'tool' WHEN 'R' THEN 'parse_error' ELSE 'other' END AS rt, CAST(length % 3 AS BIGINT) AS calls, CAST(length % 3 > 0 AS BIGINT) AS matched,
  CASE WHEN length % 3 > 0 THEN reward * 10 ELSE 0 END AS sim, round(reward * 100) AS ret, CASE WHEN length % 10 = 0 THEN NULL ELSE length % 7 END AS span, depth % 4 = 3 AS missed FROM steps JOIN rolls USING (rollout)),
p AS (SELECT *, count(*) OVER g AS n, avg(ret) OVER g AS m, coalesce(stddev_samp(ret) OVER g, 0) AS d, min(ret) OVER g <> max(ret) OVER g AS spread, rollout = min(rollout) OVER g AS first, depth = min(depth) OVER (PARTITION BY rollout, turn) AS opens FROM s WINDOW g AS (PARTITION BY uid, turn, depth)),
c AS (SELECT *, n >= 2 AND spread AND d > 0 AS act, CASE WHEN n >= 2 AND spread AND d > 0 THEN (ret - m) / (d + 1e-6) ELSE 0 END AS loc FROM p), x AS (SELECT *, a + {WEIGHT} * loc AS new, act AND coalesce(span, 0) > 0 AS app FROM c),
t AS (SELECT (SELECT sum(tokens) FROM rolls) AS k, (SELECT sum(tokens * a) FROM rolls) + (SELECT sum({WEIGHT} * loc * span) FROM x WHERE app) AS s1, (SELECT sum(tokens * a * a) FROM rolls) + (SELECT sum((new * new - a * a) * span) FROM x WHERE app) AS s2),
one AS (SELECT {{
  'call/num_predicted_calls': sum(calls), 'call/num_gt_calls': (SELECT sum(gold) FROM rolls), 'call/matched_call_count': sum(matched), 'call/unmatched_call_count': sum(calls) - sum(matched), 'call/match_rate': sum(matched) / sum(calls),
  'call/similarity_mean': sum(sim) / sum(matched), 'call/similarity_max': max(sim), 'step/policy_steps_per_user_turn': count(*) / count(*) FILTER (opens), 'step/calls_per_policy_step': avg(calls), 'step/step_reward_mean': avg(ret), 'step/local_return_mean': avg(ret), 'step/local_return_std': stddev_pop(ret),
  'interaction/non_answer_runtime_interactions': count(*), 'interaction/tool_attempt_interactions': count(*) FILTER (rt <> 'other'), 'interaction/parsed_tool_interactions': count(*) FILTER (rt = 'tool'), 'interaction/parse_error_tool_attempts': count(*) FILTER (rt = 'parse_error'), 'interaction/unparsed_runtime_interactions': count(*) FILTER (rt = 'other'),
  'interaction/peer_supported_interactions': count(*) FILTER (act), 'interaction/unsupported_local_interactions': count(*) FILTER (NOT act), 'interaction/nonzero_local_advantages': count(*) FILTER (act AND loc <> 0), 'interaction/parse_error_interactions_receiving_local_residual': count(*) FILTER (app AND rt = 'parse_error'),
  'interaction/parse_error_tokens_receiving_local_residual': sum(span) FILTER (app AND rt = 'parse_error'), 'normalization/local_support_size': count(*) / count(*) FILTER (first), 'normalization/singleton_local_count': count(*) FILTER (n < 2), 'normalization/singleton_local_rate': count(*) FILTER (n < 2) / count(*),
  'normalization/zero_variance_local_count': count(*) FILTER (first AND n >= 2 AND NOT act), 'normalization/local_adv_mean': avg(loc) FILTER (act), 'normalization/local_adv_std': stddev_pop(loc) FILTER (act), 'normalization/local_coverage': count(*) FILTER (act) / count(*),
  'fusion/A_new_mean': (SELECT s1 / k FROM t), 'fusion/A_new_std': (SELECT sqrt(s2 / k - (s1 / k) ** 2) FROM t), 'fusion/RMS_A_global': (SELECT sqrt(avg(a * a)) FROM rolls), 'fusion/RMS_A_local': sqrt(avg(loc * loc) FILTER (act)), 'fusion/RMS_A_new': sqrt(avg(new * new) FILTER (act)), 'fusion/sign_flip_rate': count(*) FILTER (act AND sign(new) <> sign(a)) / count(*) FILTER (act),
  'missing/followup_normal_turn_local_coverage': count(*) FILTER (act AND missed) / count(*) FILTER (missed), 'provenance/unreliable_rollout_count': (SELECT count(*) FROM rolls WHERE NOT reliable), 'provenance/span_assignment_failure_count': count(*) FILTER (act AND NOT app)}}::STRUCT({{columns}}) AS v FROM x)"""

NAMES = """call/num_predicted_calls call/num_gt_calls call/matched_call_count call/unmatched_call_count call/match_rate call/similarity_mean call/similarity_max step/policy_steps_per_user_turn step/calls_per_policy_step step/step_reward_mean step/local_return_mean step/local_return_std
interaction/non_answer_runtime_interactions interaction/tool_attempt_interactions interaction/parsed_tool_interactions interaction/parse_error_tool_attempts interaction/unparsed_runtime_interactions interaction/peer_supported_interactions interaction/unsupported_local_interactions interaction/nonzero_local_advantages
interaction/parse_error_interactions_receiving_local_residual interaction/parse_error_tokens_receiving_local_residual normalization/local_support_size normalization/singleton_local_count normalization/singleton_local_rate normalization/zero_variance_local_count normalization/local_adv_mean normalization/local_adv_std
normalization/local_coverage fusion/A_new_mean fusion/A_new_std fusion/RMS_A_global fusion/RMS_A_local fusion/RMS_A_new fusion/sign_flip_rate missing/followup_normal_turn_local_coverage provenance/unreliable_rollout_count provenance/span_assignment_failure_count""".split()


def credit_inputs(spark, sf):
    rolls = rollouts(spark, sf).select("rollout", "uid", F.col("category").alias("data_type"), (F.col("score") / 100000 - 1).alias("advantage"), (F.col("rollout") % 50 + 20).alias("tokens"), (F.col("rollout") % 4).alias("gold_calls"), (F.col("status") != "P").alias("reliable"))
    n = F.col("length")
    kind = F.when(F.col("flag") == "N", "tool").when(F.col("flag") == "R", "parse_error").otherwise("other")
    similarity = F.when(n % 3 > 0, F.col("reward") * 10).otherwise(0.0)
    lines = steps(spark, sf).join(rolls.select("rollout", "uid", "data_type"), "rollout")
    found = lines.select(
        "uid", "rollout", F.floor(F.col("depth") / 3).alias("turn"), (F.col("depth") % 3).alias("depth"), "data_type", kind.alias("response_type"), (n % 3).cast("long").alias("calls"), (n % 3 > 0).cast("long").alias("matched"),
        similarity.alias("similarity_sum"), similarity.alias("similarity_max"), F.round(F.col("reward") * 100).alias("step_reward"), F.round(F.col("reward") * 100).alias("local_return"), F.when(n % 10 != 0, n % 7).alias("span_tokens"), (F.col("depth") % 4 == 3).alias("follows_missing"),
    )
    return rolls.drop("uid", "data_type"), found


@query(f"""WITH {SETS_SQL.replace("{columns}", ", ".join(f'"{n}" DOUBLE' for n in NAMES)).replace("{{", "{").replace("}}", "}")},
named AS ({" UNION ALL ".join(f"SELECT '{n}' AS metric, v['{n}'] AS value FROM one" for n in NAMES)}
UNION ALL SELECT 'normalization/local_support_depth_' || depth, count(*) / count(*) FILTER (first) FROM x GROUP BY depth
UNION ALL SELECT 'by_type/' || CASE kind WHEN '1-URGENT' THEN 'Base' ELSE kind END || '/local_coverage', count(*) FILTER (act) / count(*) FROM x GROUP BY kind)
SELECT metric, round(value, 5) AS value FROM named""")
def local_credit_block(spark, sf):
    rolls, lines = credit_inputs(spark, sf)
    return M.local_credit_metrics(rolls, lines, WEIGHT, type_names={"1-URGENT": "Base"}).select("metric", F.round("value", 5).alias("value"))


@query(f"""WITH {STEPS_SQL}, s AS (SELECT o_custkey AS uid, rollout, depth, reward FROM steps JOIN orders ON rollout = o_orderkey)
SELECT rollout, depth, n AS peer_support, n >= 2 AND lo <> hi AND d > 0 AS local_active, round(CASE WHEN n >= 2 AND lo <> hi AND d > 0 THEN (reward - m) / (d + 1e-6) ELSE 0 END, 5) AS local_advantage
FROM (SELECT *, count(*) OVER g AS n, avg(reward) OVER g AS m, coalesce(stddev_samp(reward) OVER g, 0) AS d, min(reward) OVER g AS lo, max(reward) OVER g AS hi FROM s WINDOW g AS (PARTITION BY uid, depth))""")
def peer_credit(spark, sf):
    rows = steps(spark, sf).join(rollouts(spark, sf).select("rollout", "uid"), "rollout")
    return M.peer_credit(rows, ["uid", "depth"], "reward").select("rollout", "depth", "peer_support", "local_active", F.round("local_advantage", 5).alias("local_advantage"))


BOUNDARY_SQL = """g AS (SELECT o_orderkey AS uid, o_orderkey AS place, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 's' || (o_custkey // 2) END AS sample, o_orderpriority AS kind, least(o_totalprice / 300000, 1) AS p, o_orderstatus <> 'P' AS ok FROM orders),
e AS (SELECT 's' || s_suppkey AS sample, s_suppkey % 40 AS last FROM supplier),
k AS (SELECT *, 4 * p * (1 - p) AS phi, CASE WHEN p < 0.2 THEN 'too_hard' WHEN p <= 0.85 THEN 'boundary' ELSE 'mastered' END AS class, CASE WHEN p < 0.2 OR p > 0.85 THEN 'off_boundary' WHEN NOT ok THEN 'unreliable' WHEN sample = '' THEN 'unnamed' END AS early FROM g),
f AS (SELECT *, min(CASE WHEN early IS NULL THEN place END) OVER (PARTITION BY sample) AS head FROM k),
z AS (SELECT f.*, coalesce(early, CASE WHEN place <> head THEN 'repeated' WHEN kind NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') THEN 'unsupported' WHEN 50 - last < 20 THEN 'cooling' ELSE 'eligible' END) AS state FROM f LEFT JOIN e USING (sample)),
q AS (SELECT * FROM (VALUES ('1-URGENT', 40), ('2-HIGH', 1000000), ('3-MEDIUM', 3), ('5-LOW', 0)) t(kind, quota)), n AS (SELECT kind, quota, (SELECT count(*) FROM z WHERE z.kind = q.kind AND state = 'eligible') AS m FROM q)"""


def boundary(spark, sf):
    value = F.least(F.col("score") / 300000, F.lit(1.0))
    sample = F.when(F.col("rollout") % 11 == 0, "").otherwise(F.concat(F.lit("s"), F.floor(F.col("uid") / 2).cast("string")))
    groups = rollouts(spark, sf).select(F.col("rollout").alias("uid"), F.col("rollout").alias("place"), sample.alias("sample_id"), F.col("category").alias("data_type"), value.alias("mean_progress"), (F.col("status") != "P").alias("reliable"))
    emitted = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("sample_id"), (F.col("s_suppkey") % 40).alias("last_step"))
    return M.boundary_states(groups, emitted, QUOTAS, 50, 20)


@query(f"""WITH {BOUNDARY_SQL} SELECT 'seed_emitted_count' AS metric, (SELECT sum(least(m, quota)) FROM n)::DOUBLE AS value UNION ALL SELECT 'seed_selection_configured', 1 UNION ALL SELECT 'cooldown_filtered_count', (SELECT count(*) FROM z WHERE state = 'cooling')
UNION ALL SELECT 'quota_filtered_count', (SELECT sum(greatest(m - quota, 0)) FROM n) UNION ALL SELECT 'unsupported_type_count', (SELECT count(*) FROM z WHERE state = 'unsupported') UNION ALL SELECT c || '_count', (SELECT count(*) FROM z WHERE class = c) FROM (VALUES ('too_hard'), ('boundary'), ('mastered')) t(c)
UNION ALL SELECT 'boundary_rate', round((SELECT count(*) FILTER (class = 'boundary') / count(*) FROM z), 6) UNION ALL SELECT 'seed_emitted_' || kind, least(m, quota) FROM n""")
def boundary_block(spark, sf):
    return M.boundary_metrics(boundary(spark, sf), QUOTAS).select("metric", F.round("value", 6).alias("value"))


@query(f"""WITH {BOUNDARY_SQL} SELECT uid, sample AS sample_id, kind AS data_type, round(phi, 6) AS phi, r AS type_rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY phi DESC, sample, uid) AS INTEGER) AS r FROM z WHERE state = 'eligible') JOIN q USING (kind) WHERE r <= quota""")
def boundary_seeds(spark, sf):
    return M.selected_seeds(boundary(spark, sf), QUOTAS).select("uid", "sample_id", "data_type", F.round("phi", 6).alias("phi"), "type_rank")
