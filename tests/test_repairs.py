import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

import __spark_entry__ as entry
from marlstone.functions import values
from marlstone.operators import advantage, batches, credit, stats
from marlstone.sources import readers
from marlstone.streaming import lifecycle


def test_before_answer_leaves_the_answer_out(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, False), ("a", 3, True), ("b", 1, True), ("b", 2, False), ("c", 1, False), ("d", 1, True), ("d", 2, True)], "g string, k int, is boolean")
    assert sorted((r["g"], r["k"]) for r in credit.before_answer(rows, ["g"], "k", rows["is"]).collect()) == [("a", 1), ("a", 2), ("c", 1)]
    assert tuple(credit.misplaced_answers(rows, ["g"], "k", rows["is"]).first()) == (4, 2)


def test_identified_finds_pieces_of_words(spark):
    rows = spark.createDataFrame([(1, "the quick brown fox"), (2, "quick and brown"), (3, "a"), (4, None), (5, "")], "id int, text string")
    catalog = spark.createDataFrame([("q", "uick brown f"), ("b", "brown"), ("a", "a"), ("e", ""), ("n", None)], "entry string, phrase string")
    assert sorted(tuple(r) for r in batches.identified(rows, catalog, "id", "text", "entry", "phrase").collect()) == [(3, "a")]
    fewer = catalog.where("entry IN ('q', 'e')")
    assert [tuple(r) for r in batches.identified(rows, fewer, "id", "text", "entry", "phrase").collect()] == [(1, "q")]
    assert batches.identified(rows, catalog.where("entry = 'n'"), "id", "text", "entry", "phrase").count() == 0


def test_pieces_of_texts_are_not_broadcast(spark, tmp_path):
    spark.createDataFrame([(1, "the quick brown fox")], "id int, text string").write.parquet(f"{tmp_path}/texts")
    spark.createDataFrame([("q", "quick")], "entry string, phrase string").write.parquet(f"{tmp_path}/catalog")
    found = batches.identified(spark.read.parquet(f"{tmp_path}/texts"), spark.read.parquet(f"{tmp_path}/catalog"), "id", "text", "entry", "phrase")
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and [tuple(r) for r in found.collect()] == [(1, "q")]


def test_over_capacity_of_odd_suppliers(spark, tmp_path):
    """Halves, repeated suppliers and unknown capacities, as the query's SQL has them."""
    spark.createDataFrame([(1, 2.5), (1, 2.5), (2, 0.5), (3, 1.5), (4, -1.0), (5, None), (6, 0.0), (7, 3.5), (8, 2.4), (10, 2.5)], "s_suppkey long, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, n) for k in range(1, 10) for n in range(3)], "l_suppkey long, l_orderkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted(tuple(r) for r in entry.queries()["over_capacity"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    for name in ("supplier", "lineitem"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    assert got == sorted(con.sql(entry.oracle_sql()["over_capacity"]).fetchall()) == [(1, 6, 2), (2, 3, 0), (3, 3, 2), (4, 3, None), (6, 3, None), (8, 3, 2)]


def test_longest_paths_of_any_length(spark):
    chain = [("long", k, k + 1) for k in range(80)] + [("loop", 0, 1), ("loop", 1, 2), ("loop", 2, 1), ("own", 5, 5), ("fork", 0, 1), ("fork", 0, 2), ("fork", 2, 3), ("fork", 0, 1)]
    edges = spark.createDataFrame(chain, "g string, a int, b int").coalesce(1)
    assert {r["g"]: r["depth"] for r in batches.longest_paths(edges.where("g != 'long' OR a < 12"), "g", "a", "b").collect()} == {"long": 13, "loop": None, "own": None, "fork": 3}
    assert batches.longest_paths(edges.where("false"), "g", "a", "b").count() == 0


def test_metric_log_keeps_the_last_line(spark, tmp_path):
    (tmp_path / "log").write_text("step:1 - loss:0.5 - long/name:7\n\x1b[32mstep:1 - loss:0.25\x1b[0m\nnoise\nstep:2 - loss:1e-3\n")
    assert sorted(tuple(r) for r in readers.metric_log(spark, f"{tmp_path}/log").collect()) == [(1, "loss", 0.25), (2, "loss", 0.001)]
    (tmp_path / "gpu").write_text("time, power\n2024-01-01 00:00:00, 1.5e3 W\n2024-01-01 00:00:01, -2.5E-1\n")
    assert [r["power"] for r in readers.telemetry(spark, f"{tmp_path}/gpu", ["power"]).orderBy("ts").collect()] == [1500.0, -0.25]


def test_whitening_needs_two_rows(spark):
    rows = spark.createDataFrame([(1.0, 1), (2.0, 0), (3.0, 0)], "x double, m int")
    with pytest.raises(Exception, match="two rows"):
        advantage.whitened(rows, "x", "m").collect()
    assert advantage.whitened(rows, "x").count() == 3


def test_journal_tells_conflicts(spark):
    held = spark.createDataFrame([("a", "done"), ("b", "done")], "id string, status string")
    new = spark.createDataFrame([("a", "done", 1), ("a", "failed", 2), ("c", "done", 3), ("c", "done", 4), ("d", "x", 5), ("d", "y", 6)], "id string, status string, n int")
    fresh, conflicts = lifecycle.journaled(held, new, "id", ["status"])
    assert sorted((r["id"], r["status"]) for r in fresh.collect()) == [("c", "done"), ("d", "x")] and sorted(r["n"] for r in conflicts.collect()) == [2, 6]


@pytest.mark.parametrize(("number", "text", "found"), [(1234, "the 1,234th", True), (1234, "1234", True), (234, "1,234", False), (2, "2.5", False), (2, "two of them", True), (2, "twofold", False), (3, "3rd", True), (12, "Twelve!", True), (13, "thirteen", False), (1, "12", False), (5, None, False), (7, "x7.", True)])
def test_number_mentioned(spark, number, text, found):
    row = spark.createDataFrame([(number, text)], "n int, t string").select(values.number_mentioned(F.col("n"), F.col("t")).alias("x")).first()
    assert bool(row["x"]) is found


def test_bootstrap_is_the_same_at_every_partitioning(spark):
    draw = np.random.default_rng(1)
    data = [(g, k, float(x)) for g in ("a", "b", None) for k, x in enumerate(draw.normal(10, 2, 400))]
    rows = spark.createDataFrame([*data, ("one", 0, 5.0)], "g string, k int, x double")
    a, b = ({r["g"]: (r["mean"], r["lower"], r["upper"]) for r in stats.bootstrap_interval(rows.repartition(n), ["g"], "x", "k", draws=500).collect()} for n in (1, 7))
    assert set(a) == {"a", "b", None, "one"} and all(np.allclose(a[g], b[g]) for g in a) and a["one"] == (5.0, 5.0, 5.0)
    x = np.array([r[2] for r in data if r[0] == "a"])
    resampled = np.sort(draw.choice(x, (4000, len(x))).mean(1))
    assert np.allclose(a["a"][1:], (resampled[100], resampled[3899]), atol=0.06)


def test_best_of_n_is_exact(spark):
    rows = spark.createDataFrame([("g", 1.0), ("g", 1.0), ("g", 4.0), ("h", None)], "g string, x double")
    got = {(r["g"], r["n"]): (r["best"], r["worst"]) for r in stats.best_of_n(rows, ["g"], "x", [1, 2]).collect()}
    assert got == {("g", 1): (pytest.approx(2), pytest.approx(2)), ("g", 2): (pytest.approx(1 * 4 / 9 + 4 * 5 / 9), pytest.approx(1 * 8 / 9 + 4 * 1 / 9))}


def test_reducers_of_ones_own(spark):
    @F.arrow_udf(DoubleType())
    def span(lists: pa.Array) -> pa.Array:
        return pa.array([max(x) - min(x) for x in lists.to_pylist()], pa.float64())

    rows = spark.createDataFrame([(g, k, float(k)) for g in ("a", "b") for k in range(5)], "g string, k int, x double")
    got = {r["g"]: r for r in stats.bootstrapped(rows, ["g"], "x", "k", 3, {"span": span, "native": lambda x: F.array_max(x) - F.array_min(x)}, draws=200).collect()}
    assert all(r["span"] == r["native"] and r["span_std"] == r["native_std"] and 1.5 < r["span"] < 3.0 for r in got.values())
    assert got["a"]["span"] != got["b"]["span"]
