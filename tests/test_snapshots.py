import pytest
from pyspark.sql import functions as F

from marlstone.sources import snapshots as S


def test_upgrades_of_an_old_state(spark, tmp_path):
    folder, empty = f"{tmp_path}/state", "id string, mean double, n int"
    assert S.load(spark, folder, 3, {}, empty).count() == 0
    S.save(spark.createDataFrame([("a", 0.5)], "id string, score double"), folder, 1, 1)
    upgrades = {1: lambda d: d.withColumnRenamed("score", "mean"), 2: lambda d: d.withColumn("n", F.lit(0))}
    assert [tuple(r) for r in S.load(spark, folder, 3, upgrades, empty).collect()] == [("a", 0.5, 0)]
    with pytest.raises(ValueError, match="no upgrade from version 2"):
        S.load(spark, folder, 3, {1: upgrades[1]}, empty)
    S.save(S.load(spark, folder, 3, upgrades, empty).withColumn("n", F.col("n") + 1), folder, 2, 3)
    assert S.snapshots(spark, folder) == [(1, 1), (2, 3)] and S.load(spark, folder, 3, {}, empty).first()["n"] == 1
    with pytest.raises(ValueError, match="later than 2"):
        S.load(spark, folder, 2, {}, empty)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        S.save(spark.range(1), folder, 2, 3)


def test_conflicts_and_resumption(spark):
    held = spark.createDataFrame([("a", "done", 1), ("b", None, 2)], "id string, status string, n int")
    new = spark.createDataFrame([("a", "failed", 9), ("b", None, 2), ("c", "x", 3)], "id string, status string, n int")
    assert [tuple(r) for r in S.conflicting(held, new, "id", ["status", "n"]).collect()] == [("a", ["status", "n"])]
    order = spark.range(10).withColumnRenamed("id", "at")
    log = spark.createDataFrame([(0, 3), (0, 4), (1, 2)], "epoch int, rows int")
    done = {r["epoch"]: r["consumed"] for r in S.consumed_upto(log, "epoch", "rows").collect()}
    assert done == {0: 7, 1: 2} and [r["at"] for r in S.resume(order, "at", done[0], 5).collect()] == [7, 8, 9]
