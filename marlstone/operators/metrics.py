"""Metric blocks of a training step: local credit and its fusion, and the selection of boundary seeds.

A block is one pass: rollouts and their steps stand in one table, grouping sets give the figures of the whole, by
depth and by type at once, and nothing is joined but rows of figures.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP_COLUMNS = ["uid", "rollout", "turn", "depth", "data_type", "response_type", "calls", "matched", "similarity_sum", "similarity_max", "step_reward", "local_return", "span_tokens", "follows_missing"]


def peer_credit(steps: DataFrame, keys: list[str], value: str, least: int = 2, eps: float = 1e-6) -> DataFrame:
    """Adds peer_support, peer_mean, peer_deviation (sample, 0 alone), local_active and local_advantage.

    Peers are the rows of equal ``keys``. A row is active where there are ``least`` peers whose values aren't all
    equal and deviate by a finite amount; the advantage of other rows is 0. Nulls count as peers without a value.
    """
    w = Window.partitionBy(*keys)
    deviation = F.stddev_samp(value).over(w)
    deviation = F.when(deviation.isNull() | F.isnan(deviation) | (F.abs(deviation) == float("inf")), 0.0).otherwise(deviation)
    out = steps.withColumns({"peer_support": F.count("*").over(w), "peer_mean": F.avg(value).over(w), "peer_deviation": deviation, "_spread": F.min(value).over(w) != F.max(value).over(w)})
    active = (F.col("peer_support") >= least) & F.coalesce("_spread", F.lit(False)) & (F.col("peer_deviation") > 0) & F.col(value).isNotNull()
    out = out.withColumn("local_active", active)
    return out.withColumn("local_advantage", F.when(F.col("local_active"), (F.col(value) - F.col("peer_mean")) / (F.col("peer_deviation") + eps)).otherwise(0.0)).drop("_spread")


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def local_credit_metrics(rollouts: DataFrame, steps: DataFrame, weight: float, least: int = 2, eps: float = 1e-6, type_names: Mapping[str, str] | None = None) -> DataFrame:
    """metric, value: the block of local-credit figures of a batch.

    ``rollouts``: rollout, advantage (the global one), tokens (actor tokens), gold_calls, reliable. ``steps``:
    STEP_COLUMNS; (uid, turn, depth) are a step's peers; response_type is tool, parse_error or other; span_tokens
    is null or 0 where no actor token can be assigned. An active step with a span adds ``weight`` times its local
    advantage to its tokens. Figures of nothing are 0; support by depth and coverage by type follow what occurs.
    """
    # what belongs to a rollout is told while its steps lie together, so that they travel once, to their peers
    own = rollouts.groupBy("rollout").agg(F.max(F.col("advantage").cast("double")).alias("_a"))
    opens = F.col("depth") == F.min("depth").over(Window.partitionBy("rollout", "turn"))
    known = steps.withColumn("_opens", opens).join(own, "rollout", "left")
    first = F.col("rollout") == F.min("rollout").over(Window.partitionBy("uid", "turn", "depth"))  # a rollout has one step there
    credit = peer_credit(known, ["uid", "turn", "depth"], "local_return", least, eps).withColumn("_first", first)
    whole = rollouts.select(F.lit(True).alias("_whole"), F.col("advantage").cast("double").alias("_own"), F.col("tokens").cast("double").alias("_tokens"), "gold_calls", F.col("reliable").alias("_reliable"))
    both = whole.unionByName(credit.withColumn("_whole", F.lit(False)), allowMissingColumns=True)
    step, active = ~F.col("_whole"), ~F.col("_whole") & F.col("local_active")
    spanned = F.coalesce(F.col("span_tokens"), F.lit(0)) > 0
    local, tokens, a = F.col("local_advantage"), F.coalesce(F.col("span_tokens"), F.lit(0)).cast("double"), F.col("_a")
    new = a + weight * local
    applied = active & spanned
    of = lambda condition, value: F.when(condition, value)
    total = lambda condition, value=None: F.coalesce(F.sum(of(condition, F.lit(1.0) if value is None else value)), F.lit(0.0))
    known = step & F.col("response_type").isNotNull()
    parts = {
        "steps": total(step), "groups": total(step & F.col("_first")), "turns": total(step & F.col("_opens")), "calls": total(step, F.col("calls")), "matched": total(step, F.col("matched")),
        "gold": total(F.col("_whole"), F.col("gold_calls")), "similarity": total(step, F.col("similarity_sum")), "similarity_max": F.coalesce(F.max(of(step, F.col("similarity_max"))), F.lit(0.0)),
        "reward": F.avg(of(step, F.col("step_reward"))), "return_mean": F.avg(of(step, F.col("local_return"))), "return_std": F.stddev_pop(of(step, F.col("local_return"))),
        "tool": total(known & F.col("response_type").isin("tool", "parse_error")), "parsed": total(known & (F.col("response_type") == "tool")), "failed": total(known & (F.col("response_type") == "parse_error")), "other": total(step & ~F.coalesce(F.col("response_type").isin("tool", "parse_error"), F.lit(False))),
        "active": total(active), "nonzero": total(active & (local != 0)), "failed_applied": total(applied & (F.col("response_type") == "parse_error")), "failed_tokens": total(applied & (F.col("response_type") == "parse_error"), tokens),
        "singles": total(step & (F.col("peer_support") < least)), "flat": total(step & F.col("_first") & (F.col("peer_support") >= least) & ~F.col("local_active") & (F.col("peer_deviation") == 0)),
        "local_mean": F.avg(of(active, local)), "local_std": F.stddev_pop(of(active, local)), "local_square": F.avg(of(active, local * local)), "new_square": F.avg(of(active, new * new)),
        "own_square": F.avg(of(F.col("_whole"), F.col("_own") * F.col("_own"))), "flips": total(active & (F.signum(new) != F.signum(a))),
        "tokens": total(F.col("_whole"), F.col("_tokens")), "token_sum": total(F.col("_whole"), F.col("_own") * F.col("_tokens")) + total(applied, weight * local * tokens),
        "token_squares": total(F.col("_whole"), F.col("_own") * F.col("_own") * F.col("_tokens")) + total(applied, (new * new - a * a) * tokens),
        "after_missing": total(step & F.col("follows_missing")), "after_missing_active": total(active & F.col("follows_missing")),
        "unreliable": total(F.col("_whole") & ~F.coalesce("_reliable", F.lit(False))), "unspanned": total(active & ~spanned),
    }
    # an expanded row for the whole, its depth and its type; sums are made in the task before the shuffle
    sets = F.array(F.struct(F.lit("").alias("by"), F.lit(None).cast("string").alias("of")), F.when(step, F.struct(F.lit("depth").alias("by"), F.col("depth").cast("string").alias("of"))), F.when(step, F.struct(F.lit("type").alias("by"), F.coalesce("data_type", F.lit("")).alias("of"))))
    found = both.withColumn("_set", F.explode(F.filter(sets, lambda s: s.isNotNull()))).groupBy("_set").agg(*[x.alias(n) for n, x in parts.items()])
    c = F.col
    mean, square = c("token_sum") / c("tokens"), c("token_squares") / c("tokens")
    figures = {
        "call/num_predicted_calls": c("calls"), "call/num_gt_calls": c("gold"), "call/matched_call_count": c("matched"), "call/unmatched_call_count": c("calls") - c("matched"), "call/match_rate": _share(c("matched"), c("calls")),
        "call/similarity_mean": _share(c("similarity"), c("matched")), "call/similarity_max": c("similarity_max"), "step/policy_steps_per_user_turn": _share(c("steps"), c("turns")), "step/calls_per_policy_step": _share(c("calls"), c("steps")),
        "step/step_reward_mean": c("reward"), "step/local_return_mean": c("return_mean"), "step/local_return_std": c("return_std"), "interaction/non_answer_runtime_interactions": c("steps"), "interaction/tool_attempt_interactions": c("tool"),
        "interaction/parsed_tool_interactions": c("parsed"), "interaction/parse_error_tool_attempts": c("failed"), "interaction/unparsed_runtime_interactions": c("other"), "interaction/peer_supported_interactions": c("active"),
        "interaction/unsupported_local_interactions": c("steps") - c("active"), "interaction/nonzero_local_advantages": c("nonzero"), "interaction/parse_error_interactions_receiving_local_residual": c("failed_applied"),
        "interaction/parse_error_tokens_receiving_local_residual": c("failed_tokens"), "normalization/local_support_size": _share(c("steps"), c("groups")), "normalization/singleton_local_count": c("singles"),
        "normalization/singleton_local_rate": _share(c("singles"), c("steps")), "normalization/zero_variance_local_count": c("flat"), "normalization/local_adv_mean": c("local_mean"), "normalization/local_adv_std": c("local_std"),
        "normalization/local_coverage": _share(c("active"), c("steps")), "fusion/A_new_mean": F.when(c("tokens") > 0, mean), "fusion/A_new_std": F.when(c("tokens") > 0, F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)))),
        "fusion/RMS_A_global": F.sqrt("own_square"), "fusion/RMS_A_local": F.sqrt("local_square"), "fusion/RMS_A_new": F.sqrt(F.coalesce("new_square", "own_square")), "fusion/sign_flip_rate": _share(c("flips"), c("active")),
        "missing/followup_normal_turn_local_coverage": _share(c("after_missing_active"), c("after_missing")), "provenance/unreliable_rollout_count": c("unreliable"), "provenance/span_assignment_failure_count": c("unspanned"),
    }
    label = reduce(lambda a, x: F.when(c("_set.of") == x[0], x[1]).otherwise(a), (type_names or {}).items(), F.when(c("_set.of") == "", "unknown").otherwise(c("_set.of")))
    rows = F.when(c("_set.by") == "", F.array(*[F.struct(F.lit(n).alias("metric"), x.cast("double").alias("value")) for n, x in figures.items()]))
    rows = rows.when(c("_set.by") == "depth", F.array(F.struct(F.concat(F.lit("normalization/local_support_depth_"), "_set.of").alias("metric"), _share(c("steps"), c("groups")).alias("value"))))
    rows = rows.otherwise(F.array(F.struct(F.concat(F.lit("by_type/"), label, F.lit("/local_coverage")).alias("metric"), _share(c("active"), c("steps")).alias("value"))))
    return found.select(F.inline(rows)).select("metric", F.coalesce("value", F.lit(0.0)).alias("value"))


def boundary_states(groups: DataFrame, emitted: DataFrame, quotas: Mapping[str, int], step: int, cooldown: int, low: float = 0.2, high: float = 0.85) -> DataFrame:
    """Adds ``kind`` (too_hard, boundary, mastered), ``phi`` and ``state`` to groups: uid, place, sample_id, data_type, mean_progress, reliable.

    state: why a group is no candidate (off_boundary, unreliable, unnamed, repeated: a sample's later groups by
    place, unsupported: a type without a quota, cooling: emitted less than ``cooldown`` steps ago), or eligible.
    ``emitted``: sample_id, last_step, one row each.
    """
    value = F.col("mean_progress")
    rows = groups.withColumn("kind", F.when(value < low, "too_hard").when(value <= high, "boundary").otherwise("mastered")).withColumn("phi", 4.0 * value * (1.0 - value))
    named = F.coalesce(F.col("sample_id") != "", F.lit(False))
    early = F.when(F.col("kind") != "boundary", "off_boundary").when(~F.coalesce("reliable", F.lit(False)), "unreliable").when(~named, "unnamed")
    rows = rows.withColumn("_early", early)
    # the first place of each sample that is still in question, as a sum in the task before the shuffle
    firsts = rows.where("_early IS NULL").groupBy("sample_id").agg(F.min("place").alias("_place"))
    rows = rows.join(firsts, "sample_id", "left").join(emitted.select("sample_id", "last_step"), "sample_id", "left")
    state = F.when(F.col("_early").isNotNull(), F.col("_early")).when(F.col("place") != F.col("_place"), "repeated").when(~F.coalesce(F.col("data_type").isin(list(quotas)), F.lit(False)), "unsupported").when(F.lit(step) - F.col("last_step") < cooldown, "cooling").otherwise("eligible")
    return rows.withColumn("state", state).drop("_early", "_place", "last_step")


def selected_seeds(states: DataFrame, quotas: Mapping[str, int]) -> DataFrame:
    """The eligible groups of each type with the highest phi (ties: sample_id, uid), and their ``type_rank``; a quota is a bound of the caller's."""
    best = lambda kind, n: states.where((F.col("state") == "eligible") & (F.col("data_type") == kind)).orderBy(F.desc("phi"), "sample_id", "uid").limit(n)
    found = reduce(DataFrame.unionByName, [best(kind, n) for kind, n in quotas.items()])
    return found.withColumn("type_rank", F.row_number().over(Window.partitionBy("data_type").orderBy(F.desc("phi"), "sample_id", "uid")))


def boundary_metrics(states: DataFrame, quotas: Mapping[str, int], configured: bool = True) -> DataFrame:
    """metric, value: counts of what boundary_states found and of what the quotas let through (0 where selection isn't configured)."""
    kinds = states.groupBy("kind", "state", "data_type").agg(F.count("*").alias("n"))  # a few rows
    count = lambda condition: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("double")
    eligible = {k: count((F.col("state") == "eligible") & (F.col("data_type") == k)) for k in quotas}
    taken = {k: F.least(v, F.lit(float(quotas[k]))) if configured else F.lit(0.0) for k, v in eligible.items()}
    zero = F.lit(0.0)
    figures = {
        "seed_emitted_count": sum(taken.values(), zero), "seed_selection_configured": F.lit(float(configured)), "cooldown_filtered_count": count(F.col("state") == "cooling") if configured else zero,
        "quota_filtered_count": sum((eligible[k] - taken[k] for k in quotas), zero) if configured else zero, "unsupported_type_count": count(F.col("state") == "unsupported"),
        **{f"{k}_count": count(F.col("kind") == k) for k in ("too_hard", "boundary", "mastered")},
        "boundary_rate": F.coalesce(count(F.col("kind") == "boundary") / F.nullif(count(F.lit(True)), F.lit(0.0)), F.lit(0.0)), **{f"seed_emitted_{k}": v for k, v in taken.items()},
    }
    return kinds.agg(F.array(*[F.struct(F.lit(n).alias("metric"), x.alias("value")) for n, x in figures.items()]).alias("x")).select(F.inline("x"))
