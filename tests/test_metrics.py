import math

import pytest

from marlstone.operators import metrics as M


def credit(spark, steps, rolls, weight=0.5, **more):
    names = "uid string, rollout int, turn int, depth int, data_type string, response_type string, calls int, matched int, similarity_sum double, similarity_max double, step_reward double, local_return double, span_tokens int, follows_missing boolean"
    rollouts = spark.createDataFrame(rolls, "rollout int, advantage double, tokens int, gold_calls int, reliable boolean")
    return {r["metric"]: r["value"] for r in M.local_credit_metrics(rollouts, spark.createDataFrame(steps, names), weight, **more).collect()}


def step(uid, rollout, turn, depth, value, kind="base", response="tool", calls=1, span=2, missed=False):
    return (uid, rollout, turn, depth, kind, response, calls, min(calls, 1), 0.5 * min(calls, 1), 0.5 * min(calls, 1), value, value, span, missed)


def test_two_peers_and_a_lone_step(spark):
    """Two rollouts of a prompt: their first steps differ (active), the second one is alone, the third pair is equal."""
    steps = [step("p", 1, 0, 0, 1.0), step("p", 2, 0, 0, 0.0, response="parse_error"), step("p", 1, 0, 1, 3.0, calls=0, response=None), step("p", 1, 1, 0, 2.0, missed=True), step("p", 2, 1, 0, 2.0, missed=True, kind=None)]
    got = credit(spark, steps, [(1, 0.1, 10, 2, True), (2, -0.4, 10, 1, None)], type_names={"base": "Base"})
    d = 0.5 / (math.sqrt(0.5) + 1e-6)  # half of the difference over the sample deviation
    assert got["normalization/local_support_size"] == pytest.approx(5 / 3) and got["normalization/local_support_depth_0"] == 2 and got["normalization/local_support_depth_1"] == 1
    assert (got["normalization/singleton_local_count"], got["normalization/zero_variance_local_count"], got["normalization/local_coverage"]) == (1, 1, 0.4)
    assert got["normalization/local_adv_mean"] == pytest.approx(0) and got["normalization/local_adv_std"] == pytest.approx(d) and got["fusion/RMS_A_local"] == pytest.approx(d)
    assert got["fusion/RMS_A_global"] == pytest.approx(math.sqrt((0.01 + 0.16) / 2)) and got["fusion/RMS_A_new"] == pytest.approx(math.sqrt(((0.1 + d / 2) ** 2 + (-0.4 - d / 2) ** 2) / 2))
    assert got["fusion/A_new_mean"] == pytest.approx((10 * 0.1 - 10 * 0.4) / 20) and got["fusion/sign_flip_rate"] == 0
    values = [0.1 + d / 2] * 2 + [0.1] * 8 + [-0.4 - d / 2] * 2 + [-0.4] * 8
    mean = sum(values) / 20
    assert got["fusion/A_new_std"] == pytest.approx(math.sqrt(sum((v - mean) ** 2 for v in values) / 20))
    assert (got["interaction/parse_error_interactions_receiving_local_residual"], got["interaction/parse_error_tokens_receiving_local_residual"], got["interaction/unparsed_runtime_interactions"]) == (1, 2, 1)
    assert got["missing/followup_normal_turn_local_coverage"] == 0 and got["provenance/unreliable_rollout_count"] == 1
    assert got["by_type/Base/local_coverage"] == 0.5 and got["by_type/unknown/local_coverage"] == 0
    assert got["call/match_rate"] == 1 and got["call/num_gt_calls"] == 3 and got["step/policy_steps_per_user_turn"] == pytest.approx(5 / 4)


def test_flips_spans_and_support(spark):
    steps = [step("p", 1, 0, 0, 1.0, span=0), step("p", 2, 0, 0, 0.0)]
    got = credit(spark, steps, [(1, -0.1, 5, 0, True), (2, 0.9, 5, 0, True)], weight=1.0)
    assert got["fusion/sign_flip_rate"] == 0.5 and got["provenance/span_assignment_failure_count"] == 1
    assert got["fusion/A_new_mean"] == pytest.approx((-0.5 + 4.5 - 2 * (0.5 / (math.sqrt(0.5) + 1e-6))) / 10)  # the step without a span adds nothing
    assert credit(spark, steps, [(1, -0.1, 5, 0, True)], least=3)["normalization/singleton_local_rate"] == 1


def test_nothing_gives_zeros(spark):
    got = credit(spark, [], [(1, 0.5, 4, 0, True)])
    assert got["normalization/local_coverage"] == 0 and got["fusion/RMS_A_new"] == 0.5 and got["fusion/A_new_mean"] == 0.5 and got["call/match_rate"] == 0 and len(got) == 38


def test_peer_credit_of_nulls_and_infinities(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 2.0), ("b", float("inf")), ("b", 1.0), ("c", None)], "k string, v double")
    got = {(r["k"], r["v"]): (r["peer_support"], r["local_active"]) for r in M.peer_credit(rows, ["k"], "v").collect()}
    assert got == {("a", 1.0): (3, True), ("a", None): (3, False), ("a", 2.0): (3, True), ("b", float("inf")): (2, False), ("b", 1.0): (2, False), ("c", None): (1, False)}


GROUPS = [
    ("u1", 1, "s1", "base", 0.5, True), ("u2", 2, "s1", "base", 0.6, True), ("u3", 3, "s2", "base", 0.1, True), ("u4", 4, "s3", "base", 0.9, True), ("u5", 5, "s4", "base", 0.2, None),
    ("u6", 6, "", "base", 0.5, True), ("u7", 7, None, "base", 0.5, True), ("u8", 8, "s5", "rare", 0.5, True), ("u9", 9, "s6", None, 0.85, True), ("v1", 10, "s7", "base", 0.2, True), ("v2", 11, "s8", "base", 0.3, True), ("v3", 12, "s9", "long", 0.5, True), ("v4", 13, "s4", "long", 0.5, True),
]


def states(spark, rows=GROUPS, quotas=None):
    groups = spark.createDataFrame(rows, "uid string, place int, sample_id string, data_type string, mean_progress double, reliable boolean")
    emitted = spark.createDataFrame([("s8", 95), ("s7", 90)], "sample_id string, last_step int")
    return M.boundary_states(groups, emitted, quotas or {"base": 1, "long": 5}, 100, 10)


def test_boundary_states_and_figures(spark):
    found = states(spark)
    assert {r["uid"]: r["state"] for r in found.collect()} == {"u1": "eligible", "u2": "repeated", "u3": "off_boundary", "u4": "off_boundary", "u5": "unreliable", "u6": "unnamed", "u7": "unnamed", "u8": "unsupported", "u9": "unsupported", "v1": "eligible", "v2": "cooling", "v3": "eligible", "v4": "eligible"}
    got = {r["metric"]: r["value"] for r in M.boundary_metrics(found, {"base": 1, "long": 5}).collect()}
    assert got == {"seed_emitted_count": 3, "seed_selection_configured": 1, "cooldown_filtered_count": 1, "quota_filtered_count": 1, "unsupported_type_count": 2, "too_hard_count": 1, "boundary_count": 11, "mastered_count": 1, "boundary_rate": pytest.approx(11 / 13), "seed_emitted_base": 1, "seed_emitted_long": 3 - 1}
    assert {(r["uid"], r["type_rank"]) for r in M.selected_seeds(found, {"base": 1, "long": 5}).collect()} == {("u1", 1), ("v4", 1), ("v3", 2)}
    off = {r["metric"]: r["value"] for r in M.boundary_metrics(found, {"base": 1, "long": 5}, configured=False).collect()}
    assert off["seed_emitted_count"] == off["quota_filtered_count"] == off["cooldown_filtered_count"] == 0 and off["boundary_count"] == 11


def test_boundary_of_nothing(spark):
    got = {r["metric"]: r["value"] for r in M.boundary_metrics(states(spark, []), {"base": 1}).collect()}
    assert got["boundary_rate"] == 0 and got["seed_emitted_count"] == 0


def test_steps_travel_once_to_their_peers(spark):
    from marlstone.operators import metrics as M

    rolls = spark.createDataFrame([(1, 0.5, 10, 1, True)], "rollout int, advantage double, tokens int, gold_calls int, reliable boolean")
    steps = spark.createDataFrame([(9, 1, 0, 0, "a", "tool", 1, 1, 0.5, 0.5, 1.0, 1.0, 3, False)], "uid int, rollout int, turn int, depth int, data_type string, response_type string, calls long, matched long, similarity_sum double, similarity_max double, step_reward double, local_return double, span_tokens int, follows_missing boolean")
    plan = M.local_credit_metrics(rolls, steps, 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(uid" in plan and "hashpartitioning(rollout" not in plan[: plan.index("hashpartitioning(uid")]
