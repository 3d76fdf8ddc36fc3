import pytest

from marlstone.operators import validation as V


def answers(spark, rows):
    return spark.createDataFrame(rows, "source string, prompt string, k int, acc double, pred string")


def test_majority_of_certain_votes(spark):
    rows = answers(spark, [("s", "p", k, 1.0 if k < 3 else 0.0, "A" if k < 3 else "B") for k in range(3)] + [("s", "q", 0, 0.5, None), ("s", "q", 1, 0.5, None), ("t", "r", 0, 1.0, "A")])
    got = {(r["source"], r["metric"]): r["value"] for r in V.majority_metrics(rows, "source", "prompt", ["acc"], "pred", "k", draws=20).collect()}
    assert got == {("s", "maj@2/mean"): 0.75, ("s", "maj@2/std"): 0.0, ("s", "maj@3/mean"): 1.0, ("s", "maj@3/std"): 0.0}  # one answer of a prompt has no vote


def test_majority_tends_to_the_frequent(spark):
    rows = answers(spark, [("s", "p", k, float(k < 6), "A" if k < 6 else f"B{k}") for k in range(9)])
    got = {r["metric"]: r["value"] for r in V.majority_metrics(rows, "source", "prompt", ["acc"], "pred", "k", draws=400).collect()}
    assert set(got) == {f"maj@{k}/{x}" for k in (2, 4, 8, 9) for x in ("mean", "std")}
    assert got["maj@2/mean"] == pytest.approx(2 / 3, abs=0.08) and got["maj@9/mean"] > 0.9 and got["maj@4/mean"] > got["maj@2/mean"]


def test_block_and_names(spark):
    rows = answers(spark, [("s", "p", k, float(k), "A") for k in range(3)]).selectExpr("*", "acc * 2 AS reward")
    block = V.validation_block(rows, "source", "prompt", ["acc", "reward"], "k", "pred", draws=5)
    got = {r["name"]: r["value"] for r in V.named_metrics(block, "source").collect()}
    assert got["val-core/s/acc/mean@3"] == 1 and got["val-aux/s/acc/std@3"] == pytest.approx((2 / 3) ** 0.5) and got["val-aux/s/reward/mean@3"] == 2
    assert {"val-core/s/acc/best@3/mean", "val-core/s/acc/maj@3/mean", "val-aux/s/acc/best@2/mean", "val-aux/s/acc/worst@3/mean"} <= set(got)
    only = V.named_metrics(V.validation_block(rows, "source", "prompt", ["reward"], "k"), "source").collect()
    assert {r["name"] for r in only if r["name"].startswith("val-core")} == {"val-core/s/reward/mean@3", "val-core/s/reward/best@3/mean", "val-core/s/reward/best@3/std"}


def test_repeats_pairs_and_rates(spark):
    assert [r["sample_id"] for r in V.repeated_prompts(spark.createDataFrame([("p",)], "prompt string"), "prompt", 2).orderBy("sample").collect()] == ["p#0", "p#1"]
    a = spark.createDataFrame([(k, 1, 0.0) for k in range(40)] + [(99, 1, 5.0)], "k int, at int, x double")
    b = spark.createDataFrame([(k, 1, 1.0 if k % 4 else -1.0) for k in range(40)], "k int, at int, x double")
    got = V.paired_bootstrap(a, b, "k", "x", "at").first()
    assert got["pairs"] == 40 and got["mean"] == pytest.approx(0.5) and got["positive"] == 0.75 and got["lower"] < 0.5 < got["upper"]
    assert V.paired_bootstrap(a.where("k = 99"), b, "k", "x", "at").count() == 0
    rows = spark.createDataFrame([("a", True), ("a", False), ("b", True)], "c string, ok boolean")
    assert V.rates(rows, "c", rows["ok"], balanced=False).first()["macro"] == 0.75
    with pytest.raises(Exception, match="differ in size"):
        V.rates(rows, "c", rows["ok"]).collect()


def test_block_shuffles_answers_once_and_sorts_none(spark):
    rows = answers(spark, [("s", "p", k, None if k == 1 else float(k), "A") for k in range(3)] + [("s", "q", 0, None, None), (None, None, 0, 1.0, "A")]).selectExpr("*", "acc * 2 AS reward")
    block = V.validation_block(rows, "source", "prompt", ["acc", "reward"], "k", "pred", draws=5)
    plan = block._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2 and "Window" not in plan and " Sort " not in plan  # answers by prompt, measures by name
    got = {(r["source"], r["variable"], r["metric"]): r["value"] for r in block.collect()}
    assert got["s", "acc", "mean@3"] == 1 and got["s", "acc", "std@3"] == 1 and got["s", "reward", "worst@3/mean"] == pytest.approx(2 * 2 / 27)
    assert got["s", "acc", "mean@1"] is None and got[None, "reward", "mean@1"] == 2 and (None, "reward", "std@1") not in got
