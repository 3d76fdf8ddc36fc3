import json

import pytest
from pyspark.sql import functions as F

from marlstone.sources import readers
from marlstone.streaming import lifecycle


def stream(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(folder))
    return spark.readStream.schema(schema).json(str(folder))


def test_cooldown_over_two_runs(spark, tmp_path):
    schema = "id string, step long"
    run = lambda rows: lifecycle.run_once(lifecycle.with_cooldown(stream(spark, tmp_path / "in", rows, schema), "id", "step", 3), str(tmp_path / "c"), sink=str(tmp_path / "out"))
    run([("a", 1), ("a", 2), ("b", 2), ("a", 4)])
    run([("a", 6), ("a", 7), ("b", 3)])
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("a", 1), ("a", 4), ("a", 7), ("b", 2)]


def test_work_states(spark, tmp_path):
    schema, seen = "id string, n int, event string", {}

    def keep(batch, _):
        seen.update({r.id: (r.status, r.attempts) for r in batch.collect()})

    run = lambda rows: lifecycle.run_once(lifecycle.tracked(stream(spark, tmp_path / "in", rows, schema), "id", "n", "event"), str(tmp_path / "c"), keep, mode="update")
    run([("a", 1, "start"), ("a", 2, "crash"), ("b", 1, "succeed"), ("c", 1, "start")])
    assert seen == {"a": ("PENDING", 1), "b": ("PENDING", 0), "c": ("RUNNING", 1)}
    run([("a", 3, "start"), ("a", 4, "succeed"), ("a", 5, "start"), ("c", 2, "defer")])
    assert seen == {"a": ("SUCCEEDED", 2), "b": ("PENDING", 0), "c": ("PENDING", 1)}


def test_observations_and_windows(spark, tmp_path):
    seen = {}
    schema = "id string, n int, x double"
    s = lifecycle.observed(stream(spark, tmp_path / "in", [("a", 1, 0.5), ("a", 2, 1.0)], schema), "id", "x", "n")
    lifecycle.run_once(s, str(tmp_path / "c"), lambda b, _: seen.update({r.id: (r.n, r.first, r.last, r["mean"]) for r in b.collect()}), mode="update")
    assert seen == {"a": (2, 0.5, 1.0, 0.75)}


def test_admission(spark):
    pool = spark.createDataFrame([(f"p{k}",) for k in range(10)], "candidate_id string")
    ready = spark.createDataFrame([("x", 1, 3), ("y", 1, 1), ("z", 2, 0), ("w", 1, 2), ("p1", 1, 0)], "candidate_id string, epoch int, queued int")
    got = lifecycle.admitted(pool, ready, 2, 0.2, 400, ["queued"]).collect()
    assert sorted(r.candidate_id for r in got) == ["w", "y"]


def test_readers(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text("\n".join(json.dumps({"k": k % 2, "v": k}) for k in range(5)) + "\n\n")
    bad.write_text('{"k": 1, "v": 2}\n{oops\n')
    assert {r.k: r.v for r in readers.last_per_key(spark, str(good), "k int, v int", "k", "v").collect()} == {0: 4, 1: 3}
    assert [r.bad for r in readers.tolerant_jsonl(spark, str(bad), "k int, v int").collect()] == [None, "{oops"]
    with pytest.raises(Exception):
        readers.strict_jsonl(spark, str(bad), "k int, v int").collect()
    log = tmp_path / "log.txt"
    log.write_text("noise\n\x1b[36mstep:1 - a/b:0.5 - c:2\x1b[0m\nstep:2 - a/b:-1e-3\nstep:2 - a/b:0.25 - c:3\n")
    assert sorted(tuple(r) for r in readers.metric_log(spark, str(log)).collect()) == [(1, "a/b", 0.5), (1, "c", 2.0), (2, "a/b", 0.25), (2, "c", 3.0)]
    gpu = tmp_path / "gpu.csv"
    gpu.write_text("timestamp, util\n2024-01-01 00:00:00, 50 %\nbad, 1, 2\n2024-01-01 00:00:01, 70 %\n")
    assert [r.util for r in readers.telemetry(spark, str(gpu), ["util"]).orderBy("ts").collect()] == [50.0, 70.0]
    rows = spark.createDataFrame([(1, [1, 2]), (2, None)], "k int, a array<int>")
    readers.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["a", "k"]
    assert readers.markdown(rows.select("k"), ["k"]).count("|") == 8
    assert readers.append_new(rows.select("k"), spark.createDataFrame([(2,), (3,), (3,)], "k int"), "k").count() == 1


def test_counter_rates(spark):
    df = spark.sql("SELECT 'g' AS k, timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,id) AS ts, element_at(array(0L, 10L, 4L), int(id) + 1) AS c FROM range(3)")
    assert [r.rate for r in lifecycle.counter_rates(df, "k", "ts", "c").orderBy("ts").collect()] == [None, 10.0, None]
