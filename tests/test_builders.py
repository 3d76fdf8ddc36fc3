import json

import pytest
from pyspark.sql import functions as F

from marlstone.sources import builders as B


def test_training_rows(spark):
    raw = spark.createDataFrame([("b", "so #### 1,234"), ("a", "#### -2.5 then #### 3")], "question string, answer string")
    got = B.training_rows(raw, ["question"], "math", F.col("question"), B.marked_solution(F.col("answer")), "math", "train", instruction=B.STEP_BY_STEP, extra={"answer": F.col("answer")}).collect()
    assert sorted((r["extra_info"]["index"], r["prompt"][0]["content"], r["reward_model"]["ground_truth"]) for r in got) == [(0, "a " + B.STEP_BY_STEP, "-2.5"), (1, "b " + B.STEP_BY_STEP, "1234")]
    assert got[0].asDict().keys() == {"data_source", "prompt", "ability", "reward_model", "extra_info"} and got[0]["extra_info"]["split"] == "train" and got[0]["reward_model"]["style"] == "rule"
    with pytest.raises(Exception, match="without ####"):
        raw.selectExpr("'none' AS answer").select(B.marked_solution(F.col("answer"))).collect()


def test_pairs_and_search(spark):
    pairs = spark.createDataFrame([("p", "good", "bad")], "prompt string, chosen string, rejected string")
    assert [tuple(r) for r in B.supervised_rows(pairs).collect()] == [("p", "good"), ("p", "bad")]
    rows = spark.createDataFrame([("nq", "q1", (["x"],), ["y"]), (None, None, (None,), ["z"]), ("hot", "q3", None, None)], "data_source string, question string, reward_model struct<ground_truth: array<string>>, golden_answers array<string>")
    got = {r["data_source"]: (r["prompt"][-1]["content"], r["reward_model"]["ground_truth"], len(r["prompt"])) for r in B.search_rows(rows, ["question"], "test", system="answer").collect()}
    assert got == {"searchR1_nq": ("q1", ["x"], 2), "searchR1_": ("", ["z"], 2), "searchR1_hot": ("q3", [], 2)}


def test_splits_and_dumps(spark, tmp_path):
    manifest = B.write_splits({"train": spark.range(5), "validation": spark.range(2)}, f"{tmp_path}/data")
    assert sorted((r["split"], r["rows"], r["columns"]) for r in manifest.collect()) == [("train", 5, ["id"]), ("validation", 2, ["id"])]
    assert spark.read.json(f"{tmp_path}/data/manifest").count() == 2 and spark.read.parquet(f"{tmp_path}/data/train").count() == 5
    step = lambda s, n: spark.range(n).withColumns({"epoch": F.lit(0), "global_step": F.lit(s)})
    for rows in (step(1, 3), step(2, 4), step(1, 1)):
        B.dumped(rows, f"{tmp_path}/dump")
    assert {r["global_step"]: r["n"] for r in spark.read.parquet(f"{tmp_path}/dump").groupBy("global_step").agg(F.count("*").alias("n")).collect()} == {1: 1, 2: 4}


def test_lines_profile_and_appends(spark, tmp_path):
    (tmp_path / "log").write_text("\n".join(['{"a": 1}', "", "bad", "[1]", json.dumps({"b": 2})]))
    assert [tuple(r)[1:] for r in B.line_counts(spark, f"{tmp_path}/log").collect()] == [(4, 2, [3, 4])]
    rows = spark.createDataFrame([("x", 1, None), (None, None, 2), ("x", 1, 5)], "kind string, a int, b int")
    assert {(r["column"], r["value"]): r["rows"] for r in B.profile(rows, ["kind"], [rows["a"], rows["b"]]).collect()} == {("rows", None): 3, ("ids", None): 2, ("kind", "x"): 2, ("kind", None): 1}
    held = spark.createDataFrame([(1, "a")], "k int, v string")
    fresh, counts = B.appended(held, spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k int, v string"), "k")
    assert [tuple(r) for r in fresh.collect()] == [(2, "c")] and tuple(counts.first()) == (1, 2)
