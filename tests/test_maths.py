from pyspark.sql import functions as F

from marlstone.functions import maths


def test_boxed_and_numbers(spark):
    rows = [
        (r"so \boxed{1} then \boxed{\frac{3}{4}}", "0.75", True), (r"\boxed{\dfrac12}", r"\frac{1}{2}", True), (r"\boxed{1,234}", "1234", True), (r"\boxed{50\%}", "0.5", True), (r"\boxed{x = 5}", "5", True),
        (r"\boxed{\text{cat}}", "cat", True), (r"\boxed{.5}", "1/2", True), (r"\boxed{2}", "3", False), ("nothing", "3", False), (None, "3", False), (r"\boxed{\sqrt{2}}", r"\sqrt2", True), (r"\boxed{-\frac{1}{2}}", "-0.5", True), (r"\boxed{1/0}", "1", False),
    ]
    df = spark.createDataFrame(rows, "r string, g string, ok boolean")
    assert [x for x in df.select("r", "ok", (maths.score(F.col("r"), F.col("g")) == 1.0).alias("s")).collect() if x.ok != x.s] == []


def test_choices(spark):
    df = spark.createDataFrame([("The answer is (C).", "C"), ("I think [B]", "B"), ("d)", None), ("D)", "D"), ("none", None)], "t string, w string")
    assert [r for r in df.select("t", "w", maths.choice(F.col("t")).alias("c")).collect() if r.c != r.w] == []
