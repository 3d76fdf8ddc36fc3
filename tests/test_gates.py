from pyspark.sql import functions as F

from marlstone.operators import gates, retrieval, rows


def test_text_gates(spark):
    r = spark.sql("SELECT array('getUser', 'put') AS n, 'please call GETUSER now' AS t, '{\"a\":1}' AS g").select(gates.leaked(F.col("n"), F.col("t")).alias("l"), gates.visible_truth(F.concat("t", "g"), F.col("g")).alias("v"), gates.visible_truth(F.col("t"), F.lit("")).alias("e")).first()
    assert (r.l, r.v, r.e) == (["getUser"], True, False)


def test_structure_gates(spark):
    r = spark.sql("SELECT array(array('f'), array(), array()) AS g, array(array(), array('x')) AS c, map('a', '1', 'b', repeat('x', 300)) AS m").select(
        gates.idle_turn_violations(F.col("g").cast("array<array<string>>"), F.col("c").cast("array<array<string>>")).alias("i"), gates.alignment_deltas(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3))).alias("d"),
        gates.argument_failures(F.col("m"), F.array(F.lit("a"), F.lit("c")), F.array(F.lit("c"))).alias("f"),
    ).first()
    assert r.i == [1] and r.d == [2, 2] and r.f == ["long:b", "missing:c", "unknown:b"]


def test_records(spark):
    df = spark.createDataFrame([(1, "SUCCEEDED", "c", None), (2, "DROPPED", None, None), (3, "?", None, "r"), (4, "DROPPED", None, "r")], "k int, s string, c string, r string")
    got = {r.k: r.failures for r in gates.gated(df, gates.terminal_contract(F.col("s"), F.col("c"), F.col("r"))).collect()}
    assert got == {1: [], 2: ["reason"], 3: ["status", "reason"], 4: []}
    found = gates.uniquely_recoverable(spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (2, "b")], "k int, c string"), ["k"], "c").collect()
    assert {r.k: r.recoverable for r in found} == {1: True, 2: False}


def test_nearest(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 5.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "k long, v array<double>")
    got = [(r.query_id, r.id, r["rank"]) for r in retrieval.nearest(df, df.where("k = 1"), "k", "v", 2).orderBy("rank").collect()]
    assert got == [(1, 2, 1), (1, 3, 2)]
    assert retrieval.nearest(df, df.limit(0), "k", "v").count() == 0


def test_positions(spark):
    df = rows.numbered(spark.createDataFrame([("a",), ("b",), ("c",)], "t string"), ["t"])
    assert [r.t for r in rows.at_positions(df, "row_id", [2, 0, 0]).collect()] == ["c", "a", "a"]
