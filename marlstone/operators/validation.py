"""A validation run: repeated prompts, metrics of several variables with majority votes, names of what counts, and paired runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import paired_difference
from .reports import moments, prompt_metrics, subset_sizes
from .stats import bootstrap_interval


def repeated_prompts(prompts: DataFrame, prompt: str, times: int) -> DataFrame:
    """Every prompt ``times`` times, with ``sample``, the number of the repeat, and ``sample_id``, the same for every run."""
    rows = prompts.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return rows.withColumn("sample_id", F.concat_ws("#", F.col(prompt).cast("string"), F.col("sample").cast("string")))


def _answers(rows: DataFrame, source: str, prompt: str, variables: list[str], order: str | None, pred: str | None) -> DataFrame:
    """source, prompt, _a: each prompt's answers, sorted: order, _pred, _v0, _v1, ... (the values of the variables)."""
    first = [] if pred is None else [F.col(order).alias("_at"), F.col(pred).alias("_pred")]
    each = F.struct(*first, *[F.col(v).cast("double").alias(f"_v{k}") for k, v in enumerate(variables)])
    return rows.groupBy(source, prompt).agg(F.array_sort(F.collect_list(each)).alias("_a"))


def _votes(source: str, prompt: str, variables: list[str], draws: int, seed: int) -> Column:
    """Array of (variable, metric, value) of the votes over resamples of a prompt's answers, one resample after the other."""
    n, a = F.size("_a"), F.col("_a")
    lot = lambda k, d, j: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(source).cast("string"), F.col(prompt).cast("string"), k.cast("string"), d.cast("string"), j.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")

    def elected(p: Column) -> Column:
        votes = F.transform(p, lambda x, j: F.struct(F.size(F.filter(p, lambda y: y["_pred"].eqNullSafe(x["_pred"]))).alias("c"), (-j).alias("at"), x.alias("x")))
        return F.aggregate(votes, F.struct(F.lit(-1).alias("c"), F.lit(0).alias("at"), F.get(p, F.lit(0)).alias("x")), lambda s, v: F.when((v["c"] > s["c"]) | ((v["c"] == s["c"]) & (v["at"] > s["at"])), v).otherwise(s), lambda s: s["x"])

    def resample(k: Column, d: Column) -> Column:
        picked = F.transform(F.sequence(F.lit(0).cast("long"), k - 1), lambda j: F.get(a, (lot(k, d, j) % n).cast("int")))
        return F.get(F.transform(F.array(picked), elected), F.lit(0))

    told = lambda k: F.struct(k.alias("k"), F.transform(F.sequence(F.lit(0), F.lit(draws - 1)), lambda d: resample(k, d)).alias("x"))
    named = lambda t, v, what, value: F.struct(F.lit(v).alias("variable"), F.concat(F.lit("maj@"), t["k"].cast("string"), F.lit(what)).alias("metric"), value.alias("value"))

    def listed(t: Column) -> Column:
        of = lambda v, k: F.transform(F.array(moments(t["x"][f"_v{k}"])), lambda m: F.array(named(t, v, "/mean", m["mean"]), named(t, v, "/std", m["spread"])))
        return F.flatten(F.concat(*[of(v, k) for k, v in enumerate(variables)]))

    return F.flatten(F.transform(F.transform(F.when(n > 1, subset_sizes(n)).otherwise(F.array().cast("array<bigint>")), told), listed))


def _averaged(held: DataFrame, source: str, listed: Column) -> DataFrame:
    return held.select(source, F.inline(listed)).groupBy(source, "variable", "metric").agg(F.avg("value").alias("value"))


def majority_metrics(rows: DataFrame, source: str, prompt: str, variables: list[str], pred: str, order: str, draws: int = 1000, seed: int = 42) -> DataFrame:
    """source, variable, metric, value: maj@k/mean and maj@k/std over seeded resamples of k answers to a prompt.

    The vote is the most frequent ``pred`` of a resample (the first of equals), its value that of the first answer
    that gives it. Lots depend on the seed, the prompt, k, the draw and the place. The answers to a prompt are one
    array. Prompts are averaged within a source; prompts of one answer have no votes.
    """
    return _averaged(_answers(rows, source, prompt, variables, order, pred), source, _votes(source, prompt, variables, draws, seed))


def validation_block(rows: DataFrame, source: str, prompt: str, variables: list[str], order: str, pred: str | None = None, draws: int = 1000, seed: int = 42) -> DataFrame:
    """source, variable, metric, value of the numeric variables: what validation_metrics gives for each, and votes where there is a ``pred``.

    Rows are shuffled once; all that a prompt comes to is made from the array of its answers.
    """
    of = lambda v, k: F.transform(prompt_metrics(F.col(f"_s{k}")), lambda m: F.struct(F.lit(v).alias("variable"), m["metric"].alias("metric"), m["value"].alias("value")))
    listed = [of(v, k) for k, v in enumerate(variables)] + ([] if pred is None else [_votes(source, prompt, variables, draws, seed)])
    held = _answers(rows, source, prompt, variables, order, pred).select("*", *[F.sort_array(f"_a._v{k}").alias(f"_s{k}") for k in range(len(variables))])
    return _averaged(held, source, F.concat(*listed))


def named_metrics(block: DataFrame, source: str, core: tuple[str, str] = ("acc", "reward")) -> DataFrame:
    """name, value: val-core/... for the means, votes and bests at the largest n of a source's core variable, val-aux/... for the rest.

    The core variable is the first of ``core`` if the source has it, else the second.
    """
    by = Window.partitionBy(source, "variable")  # a few metrics
    n = F.regexp_extract("metric", "@([0-9]+)", 1).cast("long")
    rows = block.withColumn("_n", F.max(n).over(by)).withColumn("_has", F.max(F.col("variable") == core[0]).over(Window.partitionBy(source)))
    is_core = (F.col("variable") == F.when(F.col("_has"), core[0]).otherwise(core[1])) & F.col("metric").rlike("^(mean|maj|best)") & F.contains("metric", F.concat(F.lit("@"), F.col("_n").cast("string")))
    return rows.select(F.concat_ws("/", F.when(is_core, "val-core").otherwise("val-aux"), F.col(source).cast("string"), "variable", "metric").alias("name"), "value")


def paired_bootstrap(a: DataFrame, b: DataFrame, key: str, value: str, order: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """pairs, mean, lower, upper, positive: the mean of b - a over keys of both, its interval, and the share of pairs above 0; no row without pairs."""
    found = paired_difference(a, b, key, value, order).where("difference IS NOT NULL").withColumn("_all", F.lit(0))
    share = found.groupBy("_all").agg(F.count("*").alias("pairs"), F.avg((F.col("difference") > 0).cast("double")).alias("positive"))
    return share.join(bootstrap_interval(found, ["_all"], "difference", key, draws, seed), "_all").select("pairs", "mean", "lower", "upper", "positive")


def rates(rows: DataFrame, category: str, right: Column, balanced: bool = True) -> DataFrame:
    """micro, macro: the rate over all rows and the mean of the categories' rates; ``balanced``: categories of other sizes raise."""
    by = rows.groupBy(category).agg(F.avg(right.cast("double")).alias("_rate"), F.count("*").alias("_n"))
    uneven = F.raise_error(F.lit("categories differ in size")).cast("double")
    macro = F.when(F.min("_n") == F.max("_n"), F.avg("_rate")).otherwise(uneven) if balanced else F.avg("_rate")
    return by.agg((F.sum(F.col("_rate") * F.col("_n")) / F.sum("_n")).alias("micro"), macro.alias("macro"))
