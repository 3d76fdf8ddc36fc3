"""Golden and property cases of the operators."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import advantage, gates, joins, select, sets, stats


def test_published_credit_chain(spark):
    rewards = [0.0] * 5 + [1.0]
    df = spark.createDataFrame([("r", k, x) for k, x in enumerate(rewards)], "r string, k int, x double")
    got = [r.discounted for r in advantage.discounted_returns(df, ["r"], ["k"], "x", 0.9).orderBy("k").collect()]
    assert [round(x, 6) for x in got] == [0.590490, 0.656100, 0.729000, 0.810000, 0.900000, 1.0]
    df = spark.createDataFrame([("r", 0, 1.0), ("r", 1, 0.5), ("r", 2, 0.0)], "r string, k int, x double")
    assert [round(r.discounted, 6) for r in advantage.discounted_returns(df, ["r"], ["k"], "x").orderBy("k").collect()] == [1.45, 0.5, 0.0]


def test_published_group_statistics(spark):
    returns = [1.9] * 14 + [1.825, 0.590490]
    df = spark.createDataFrame([(1, float(x)) for x in returns] + [(2, 5.0)], "g int, x double")
    got = df.select("g", "x", advantage.group_normalised(F.col("x"), ["g"]).alias("a"), advantage.ragged_normalised(F.col("x"), ["g"]).alias("b"), advantage.leave_one_out(F.col("x"), ["g"]).alias("c")).collect()
    by = {(r.g, round(r.x, 6)): r for r in got}
    assert round(by[1, 1.9].a, 4) == 0.2649 and round(by[1, 1.825].a, 4) == 0.0353 and round(by[1, 0.59049].a, 4) == -3.7438
    assert round(by[2, 5.0].a, 4) == 5.0 and by[2, 5.0].b == 0.0 and by[2, 5.0].c == 5.0


def test_ragged_support(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 1.0), (1, 2.0), (1, 3.0), (2, 4.0)], "d int, x double")
    got = df.select("d", F.round(advantage.ragged_normalised(F.col("x"), ["d"]), 4).alias("a")).collect()
    assert sorted((r.d, r.a) for r in got) == [(0, 0.0), (0, 0.0), (1, -0.7071), (1, 0.7071), (2, 0.0)]


def test_masks(spark):
    df = spark.createDataFrame([(k, x) for k, x in enumerate([5, 2, 7, 2, 9])], "k int, x int").withColumn("s", F.lit(1))
    got = df.select("k", advantage.first_end_mask(F.col("x") == 2, ["s"], ["k"]).alias("m")).orderBy("k").collect()
    assert [r.m for r in got] == [1, 1, 0, 0, 0]


def test_assignment_goldens(spark):
    df = spark.createDataFrame([("t", i, j, w) for i, j, w in ((0, 0, 0.9), (0, 1, 0.8), (1, 0, 0.85), (1, 1, 0.0))], "t string, i int, j int, w double")
    assert sorted((r.i, r.j, r.w) for r in joins.optimal_assignment(df, ["t"], "i", "j", "w").collect()) == [(0, 1, 0.8), (1, 0, 0.85)]
    twice = spark.createDataFrame([("t", 0, 0, 1.0), ("t", 1, 0, 1.0)], "t string, i int, j int, w double")
    assert [(r.j, r.w) for r in joins.optimal_assignment(twice, ["t"], "i", "j", "w").collect()] == [(0, 1.0)]


def test_assignment_is_optimal(spark):
    rng, rows, best = random.Random(3), [], {}
    for g in range(40):
        n, m = rng.randrange(1, 5), rng.randrange(1, 6)
        w = [[rng.choice([0.0, round(rng.random(), 3)]) for _ in range(m)] for _ in range(n)]
        rows += [(g, i, j, w[i][j]) for i in range(n) for j in range(m)]
        wide = [r + [0.0] * n for r in w]
        best[g] = max(sum(wide[i][p[i]] for i in range(n)) for p in itertools.permutations(range(m + n), n))
    got = joins.optimal_assignment(spark.createDataFrame(rows, "g int, i int, j int, w double"), ["g"], "i", "j", "w").collect()
    assert all(len({r.i for r in got if r.g == g}) == len({r.j for r in got if r.g == g}) == sum(r.g == g for r in got) for g in best)
    assert all(abs(sum(r.w for r in got if r.g == g) - best[g]) < 1e-9 for g in best)


def test_packing(spark):
    df = spark.createDataFrame([("b", k, n) for k, n in enumerate([12, 11, 10, 9, 8, 7])], "b string, k int, n int")
    got = select.packed(df, ["b"], "k", "n", 16).collect()
    loads = {r.bin: r.load for r in got}
    assert len(got) == 6 and max(loads.values()) <= 16 and sum(loads.values()) == 57 and len(loads) == 5
    with pytest.raises(Exception, match="above the cap"):
        select.packed(df, ["b"], "k", "n", 11).collect()
    parts = select.balanced(df, ["b"], "k", "n", 3, equal=True).groupBy("part").count().collect()
    assert sorted(r["count"] for r in parts) == [2, 2, 2]
    dealt = {r.k: r.part for r in select.least_loaded(df, ["b"], "k", "n", 2).collect()}
    assert dealt == {0: 0, 1: 1, 2: 1, 3: 0, 4: 0, 5: 1} or len(dealt) == 6


def test_loss_mean_and_votes(spark):
    df = spark.createDataFrame([(0, 2.0, 1), (0, 4.0, 1), (0, 100.0, 0), (1, 1.0, 1), (1, 3.0, 1), (1, 5.0, 1)], "s int, x double, m int")
    assert stats.loss_mean(df, "s", "x", "m").first().loss == 3.0
    votes = spark.createDataFrame([(1, "A", 0.9, 0), (1, "B", 0.8, 1), (1, "A", 0.7, 2)], "g int, v string, x double, k int")
    r = stats.majority_vote(votes, ["g"], "v", "x", "k").first()
    assert (r.v, r.votes, r.x) == ("A", 2, 0.9)
    long = spark.createDataFrame([("loss", float(x)) for x in (1, 2, 3)] + [("max_reward", float(x)) for x in (5, 8, 6)] + [("min_error", x) for x in (0.1, 0.05, 0.2)], "n string, x double")
    assert {r.n: r.value for r in stats.reduced_metrics(long, "n", "x").collect()} == {"loss": 2.0, "max_reward": 8.0, "min_error": 0.05}


def test_bootstrap_is_seeded(spark):
    df = spark.createDataFrame([("g", k, float(k % 5)) for k in range(50)], "g string, k int, x double")
    a, b = (stats.bootstrap_interval(df, ["g"], "x", "k", draws=100).first() for _ in range(2))
    assert a == b and a.lower < a["mean"] < a.upper


def test_positional_join_raises(spark):
    a, b = spark.createDataFrame([(0, 1), (1, 2)], "r int, x int"), spark.createDataFrame([(0, 1, 5), (1, 2, 6)], "r int, x int, y int")
    assert sorted(tuple(r) for r in joins.positional(a, b, "r").collect()) == [(0, 1, 5), (1, 2, 6)]
    with pytest.raises(Exception, match="don't match"):
        joins.positional(a, b.where("r = 0"), "r").collect()
    with pytest.raises(Exception, match="missing key"):
        joins.required(a, spark.createDataFrame([(7,)], "r int"), "r").collect()


def test_spans(spark):
    points = spark.createDataFrame([(1, k) for k in range(30)], "g int, k int")
    spans = spark.createDataFrame([(1, 3, 8), (1, 7, 25), (1, 9, 9), (2, 0, 30)], "g int, s int, e int")
    got = joins.in_spans(points, spans, "g", "k", "s", "e", 10).count()
    assert got == 5 + 18


def test_exactly_once(spark):
    held = spark.createDataFrame([("a", "1")], "k string, f string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("b", "2")], "k string, f string")
    assert [tuple(r) for r in sets.appended_once(held, new, "k", "f").collect()] == [("b", "2")]
    with pytest.raises(Exception, match="conflicting"):
        sets.appended_once(held, spark.createDataFrame([("a", "9")], "k string, f string"), "k", "f").collect()


def test_gates(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "k int, t string")
    ok, bad = gates.routed(df, {"small": F.col("k") < 5, "text": F.col("t") == "x"})
    assert ok.count() == 1 and bad.first().failures == ["text"]
    turns = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 2), (3, 0), (3, 0)], "g int, k int")
    assert {r.g for r in gates.contiguous(turns, ["g"], "k").collect()} == {1}
    steps = spark.createDataFrame([(1, 0, None), (1, 1, "e"), (1, 2, "f"), (2, 0, None)], "g int, k int, e string")
    assert sorted((r.g, r.failed_at, r.error) for r in gates.first_failure(steps, ["g"], "k", "e").collect()) == [(1, 1, "e"), (2, None, None)]
