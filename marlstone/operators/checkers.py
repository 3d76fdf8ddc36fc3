"""Checks of conversations turn by turn against what was expected: state, responses, idle turns; the first failure counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def state_mismatches(model: DataFrame, gold: DataFrame, keys: list[str], place: str = "place", name: str = "class") -> DataFrame:
    """keys, class, place, attribute, model, gold: public attributes whose values differ or that the model's state lacks.

    Both tables: keys, class, place (order of the classes), attribute, value. Names that begin with _ are private.
    """
    public = gold.where(~F.col("attribute").startswith("_"))
    found = public.withColumnRenamed("value", "gold").join(model.select(*keys, name, "attribute", F.col("value").alias("model"), F.lit(True).alias("_there")), [*keys, name, "attribute"], "left")
    return found.where(F.col("_there").isNull() | ~F.col("model").eqNullSafe(F.col("gold"))).select(*keys, name, place, "attribute", "model", "gold")


def missing_responses(model: DataFrame, gold: DataFrame, keys: list[str], turn: str, value: str) -> DataFrame:
    """keys, turn, value, missing: expected results of a turn that the model's results up to and with it don't cover, as often as they lack.

    A running count for each value, not a list for each row: equal results are added up before anything is ordered.
    """
    tally = lambda rows, out, other: rows.groupBy(*keys, turn, value).agg(F.count("*").alias(out)).withColumn(other, F.lit(0).cast("long"))
    both = tally(model, "_m", "_g").unionByName(tally(gold, "_g", "_m")).groupBy(*keys, turn, value).agg(F.sum("_m").alias("_m"), F.sum("_g").alias("_g"))
    upto = F.sum("_m").over(Window.partitionBy(*keys, value).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("missing", F.col("_g") - upto).where("_g > 0 AND missing > 0").select(*keys, turn, value, "missing")


def checked_turns(turns: DataFrame, mismatches: DataFrame, missing: DataFrame, keys: list[str], turn: str = "turn") -> DataFrame:
    """keys, valid, turn, error, subject of each conversation: its first failing turn.

    ``turns``: keys, turn, gold_calls, model_calls. A turn with expected calls fails if the model made none
    (empty_response), else by its state (state_mismatch, subject: the first class by place), else by its results
    (response_mismatch). Turns without expected calls are not checked here.
    """
    states = mismatches.groupBy(*keys, turn).agg(F.min(F.struct("place", "class"))["class"].alias("_class"))
    lacks = missing.select(*keys, turn).distinct().withColumn("_lacks", F.lit(True))
    rows = turns.join(states, [*keys, turn], "left").join(lacks, [*keys, turn], "left")
    error = F.when(F.col("gold_calls") == 0, None).when(F.col("model_calls") == 0, "empty_response").when(F.col("_class").isNotNull(), "state_mismatch").when(F.col("_lacks"), "response_mismatch")
    rows = rows.withColumn("_error", error).withColumn("_subject", F.when(F.col("_error") == "state_mismatch", F.col("_class")))
    first = F.min(F.when(F.col("_error").isNotNull(), F.struct(F.col(turn).alias("t"), F.col("_error").alias("e"), F.col("_subject").alias("s"))))
    return rows.groupBy(*keys).agg(first.alias("_f")).select(*keys, F.col("_f").isNull().alias("valid"), F.col("_f.t").alias(turn), F.col("_f.e").alias("error"), F.col("_f.s").alias("subject"))


def idle_turn_failures(turns: DataFrame, keys: list[str], turn: str = "turn") -> DataFrame:
    """keys, turn: the first turn without expected calls in which the model made some; conversations without one don't occur."""
    return turns.where("gold_calls = 0 AND model_calls > 0").groupBy(*keys).agg(F.min(turn).alias(turn))


def forced_score(gold_calls: Column, response: Column, attempts: Column, limit: int, advanced: Column) -> Column:
    """The score of a step that ends without execution; null where calls are to be executed.

    A parse error scores -3 until the attempts (with this one) exceed ``limit``; then the turn is left with the
    score of advancing, or 0 where no call was expected. In a turn without expected calls an answer scores 1 and
    a call 0.
    """
    quits = F.when(gold_calls == 0, 0.0).otherwise(advanced)
    return F.when(response == "parse_error", F.when(attempts + 1 > limit, quits).otherwise(-3.0)).when(gold_calls == 0, F.when(response == "answer", 1.0).when(response == "tool_call", 0.0))
