"""Reports over batches of rollouts: metric blocks, validation metrics, timings, coverage and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def metric_block(rows: DataFrame, values: list[str], length: str, limit: float, returns: str, predicted: str) -> DataFrame:
    """One row: mean, max and min of each value, the share of rows at the length limit, explained variance of the returns."""
    parts = [f(v).alias(f"{v}_{n}") for v in values for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    clipped = F.avg((F.col(length) == limit).cast("double")).alias("clip_ratio")
    explained = (1 - F.var_samp(F.col(returns) - F.col(predicted)) / F.var_samp(returns)).alias("explained_variance")
    return rows.agg(*parts, clipped, explained)


def stage_timings(rows: DataFrame, stage: str, seconds: str, response_tokens: str, all_tokens: str, response_stages: list[str]) -> DataFrame:
    """Seconds of each stage and milliseconds a token; generation counts response tokens, other stages all tokens."""
    tokens = F.when(F.col(stage).isin(response_stages), F.col(response_tokens)).otherwise(F.col(all_tokens))
    return rows.groupBy(stage).agg(F.sum(seconds).alias("seconds"), (F.sum(seconds) * 1000 / F.sum(tokens)).alias("ms_per_token"))


def throughput(rows: DataFrame, tokens: str, seconds: float, devices: int) -> DataFrame:
    """Total tokens, and tokens for a second and device."""
    return rows.agg(F.sum(tokens).alias("tokens"), (F.sum(tokens) / (seconds * devices)).alias("throughput"))


def mean_of_means(rows: DataFrame, source: str, prompt: str, score: str) -> DataFrame:
    """Mean score of each prompt's responses, averaged within each source."""
    return rows.groupBy(source, prompt).agg(F.avg(score).alias("_m")).groupBy(source).agg(F.avg("_m").alias("score"), F.count("*").alias("prompts"))


def subset_sizes(n: Column) -> Column:
    """2, 4, 8, ... below n, and n."""
    powers = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(n.cast("double"))), F.lit(1)).cast("int")), lambda j: F.pow(F.lit(2.0), j).cast("long")), lambda k: k < n)
    return F.array_append(powers, n.cast("long"))


def moments(values: Column) -> Column:
    """(mean, spread) of an array's numbers, the spread of the population; nulls don't count, null where there are none."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "sum", "mean", "squares")])

    def added(s: Column, x: Column) -> Column:
        mean = s["mean"] + (x - s["mean"]) / (s["n"] + 1)
        more = F.struct((s["n"] + 1).alias("n"), (s["sum"] + x).alias("sum"), mean.alias("mean"), (s["squares"] + (x - s["mean"]) * (x - mean)).alias("squares"))
        return F.when(x.isNull(), s).otherwise(more)

    told = lambda s: F.struct(F.try_divide(s["sum"], s["n"]).alias("mean"), F.sqrt(F.try_divide(s["squares"], s["n"])).alias("spread"))
    return F.aggregate(values, zero, added, told)


def prompt_metrics(values: Column) -> Column:
    """Array of (metric, value) of one prompt's values, a column of arrays of doubles in order, nulls first: what validation_metrics averages."""
    n = F.size(values).cast("double")
    named = lambda name, k, what, value: F.struct(F.concat(F.lit(name), k.cast("long").cast("string"), F.lit(what)).alias("metric"), value.alias("value"))

    def drawn(k: Column) -> Column:
        most = lambda i: F.pow((i + 1) / n, k) - F.pow(i / n, k)
        least = lambda i: F.pow((n - i) / n, k) - F.pow((n - i - 1) / n, k)
        terms = F.transform(values, lambda v, i: F.when(v.isNotNull(), F.struct((v * most(i)).alias("b"), (v * v * most(i)).alias("b2"), (v * least(i)).alias("w"), (v * v * least(i)).alias("w2"))))
        none = F.struct(*[F.lit(None).cast("double").alias(c) for c in ("b", "b2", "w", "w2")])
        added = lambda s, t, c: F.when(t.isNull(), s[c]).otherwise(F.coalesce(s[c], F.lit(0.0)) + t[c]).alias(c)
        return F.aggregate(terms, none, lambda s, t: F.struct(*[added(s, t, c) for c in ("b", "b2", "w", "w2")]), lambda s: F.struct(k.alias("k"), *[s[c].alias(c) for c in ("b", "b2", "w", "w2")]))

    of = lambda m, s: F.when(s.isNotNull(), F.sqrt(F.greatest(s - m * m, F.lit(0.0))))
    sums = F.transform(F.when(n > 1, subset_sizes(n)).otherwise(F.array().cast("array<bigint>")), lambda k: drawn(k.cast("double")))
    listed = F.flatten(F.transform(sums, lambda s: F.array(
        named("best@", s["k"], "/mean", s["b"]), named("best@", s["k"], "/std", of(s["b"], s["b2"])), named("worst@", s["k"], "/mean", s["w"]), named("worst@", s["k"], "/std", of(s["w"], s["w2"])))))
    plain = F.flatten(F.transform(F.array(moments(values)), lambda m: F.array(named("mean@", n, "", m["mean"]), named("std@", n, "", m["spread"]))))
    return F.concat(F.when(n > 1, plain).otherwise(F.slice(plain, 1, 1)), listed)


def validation_metrics(rows: DataFrame, source: str, prompt: str, value: str) -> DataFrame:
    """source, metric, value: mean@n, population std@n and, for k = 2, 4, ... and n, best@k and worst@k with their spread.

    Best and worst are the exact expectation and deviation over k draws with replacement, which resampling only
    estimates: the i-th smallest of n values is the largest of k draws with chance (i/n)^k - ((i-1)/n)^k. Prompts are
    averaged within a source for each metric. A prompt's values are one array, so each row is shuffled once and what
    a prompt comes to is held by no table of groups.
    """
    held = rows.groupBy(source, prompt).agg(F.array_sort(F.collect_list(F.struct(F.col(value).cast("double").alias("v")))).alias("_a"))
    return held.select(source, F.col("_a.v").alias("_v")).select(source, F.inline(prompt_metrics(F.col("_v")))).groupBy(source, "metric").agg(F.avg("value").alias("value"))


def aggregate_with_counters(rows: DataFrame, keys: list[str], means: list[str], code: str, codes: list) -> DataFrame:
    """Mean of each measure and merged counters of the codes, for each combination of keys."""
    counters = [F.count_if(F.col(code) == c).alias(f"count_{c}") for c in codes]
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.avg(m).alias(f"mean_{m}") for m in means], *counters)


def compared(rows: DataFrame, key: str, model: str, models: list[str], value: str) -> DataFrame:
    """The mean of each model as a column, and the differences of each pair of models."""
    wide = rows.groupBy(key).agg(*[F.avg(F.when(F.col(model) == m, F.col(value))).alias(m) for m in models])
    pairs = [(a, b) for k, a in enumerate(models) for b in models[k + 1 :]]
    return wide.select(key, *models, *[(F.col(b) - F.col(a)).alias(f"{a}_to_{b}") for a, b in pairs])


def step_means(rows: DataFrame, step: str, metrics: list[str], last: int) -> DataFrame:
    """step, rows, mean of the first metric that is there (0 where none is), for steps 1 to last; missing steps have null."""
    value = F.coalesce(*[F.col(m) for m in metrics], F.lit(0.0))
    found = rows.where(F.col(step).between(1, last)).groupBy(F.col(step).cast("long").alias("step")).agg(F.count("*").alias("rows"), F.avg(value).alias("mean"))
    every = rows.sparkSession.range(1, last + 1).toDF("step")
    return every.join(found, "step", "left").select("step", F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), "mean")


def device_peaks(rows: DataFrame, device: Column, at: str, values: list[str]) -> DataFrame:
    """Peak and mean of the telemetry of each device, first and last time, and seconds between."""
    peaks = [f(v).alias(f"{n}_{v}") for v in values for n, f in (("peak", F.max), ("mean", F.avg))]
    times = [F.min(at).alias("first"), F.max(at).alias("last"), ((F.unix_micros(F.max(at).cast("timestamp")) - F.unix_micros(F.min(at).cast("timestamp"))) / 1e6).alias("seconds")]
    return rows.groupBy(device.alias("device")).agg(*peaks, *times)


def weighted_rate(rows: DataFrame, rate: Column, weight: Column) -> DataFrame:
    """A rate averaged with weights, null without any weight."""
    return rows.agg((F.sum(rate * weight) / F.nullif(F.sum(weight), F.lit(0))).alias("rate"))


def global_moments(rows: DataFrame, value: str, mask: Column | None = None) -> DataFrame:
    """Mean, max, min, sample deviation and, with a mask, the masked mean, from partial sums of each task."""
    more = [] if mask is None else [(F.sum(F.col(value) * mask) / (F.sum(mask) + 1e-8)).alias("masked_mean")]
    return rows.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.stddev_samp(value).alias("std"), *more)


def imbalance(rows: DataFrame, length: str, before: str, after: str) -> DataFrame:
    """Smallest, largest, their difference and mean of the parts' total lengths, before and after a partitioning."""
    sums = lambda part, name: rows.groupBy(part).agg(F.sum(length).alias("s")).agg(F.min("s").alias(f"{name}min"), F.max("s").alias(f"{name}max"), (F.max("s") - F.min("s")).alias(f"{name}diff"), F.avg("s").alias("mean"))
    return sums(before, "").crossJoin(F.broadcast(sums(after, "balanced_").drop("mean")))  # one row each


def zero_filled(rows: DataFrame, name: str, names: list[str], latency: str) -> DataFrame:
    """Count and latency sum and mean of every listed name, zero where it doesn't occur."""
    listed = rows.sparkSession.createDataFrame([(n,) for n in names], f"{name} string")
    found = rows.groupBy(name).agg(F.count("*").alias("n"), F.sum(latency).alias("s"))
    count, total = F.coalesce("n", F.lit(0)).cast("long"), F.coalesce("s", F.lit(0.0))
    return listed.join(found, name, "left").select(name, count.alias("count"), total.alias("latency_sum"), F.coalesce(total / F.nullif(count, F.lit(0)), F.lit(0.0)).alias("latency_mean"))


def human_size(size: Column) -> Column:
    """A size in bytes with its unit, two decimals."""
    units = ["B", "KB", "MB", "GB", "TB"]
    out = F.format_string("%.2f TB", F.bround(size / 1024.0**4, 2))
    for k in range(3, -1, -1):
        out = F.when(size < 1024.0 ** (k + 1), F.format_string(f"%.2f {units[k]}", F.bround(size / 1024.0**k, 2))).otherwise(out)
    return out


def sizes_by_path(rows: DataFrame, path: list[str], size: str) -> DataFrame:
    """Total size of every prefix of a path, and the same with a unit."""
    return rows.rollup(*path).agg(F.sum(size).alias("size")).withColumn("human", human_size(F.col("size").cast("double")))


def inbox(rows: DataFrame, owner: str, other: str) -> DataFrame:
    """Messages of each owner and how many others they are with."""
    return rows.groupBy(owner).agg(F.count("*").alias("messages"), F.countDistinct(other).alias("others"))


def conditional_counts(rows: DataFrame, key: str, conditions: dict[str, Column]) -> DataFrame:
    """For each key the rows that meet each condition."""
    return rows.groupBy(key).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def audit(rows: DataFrame, kind: str, category: str, key: str, well_formed: Column) -> DataFrame:
    """Rows, distinct ids and malformed rows of each kind and category."""
    return rows.groupBy(kind, category).agg(F.count("*").alias("rows"), F.countDistinct(key).alias("ids"), F.count_if(~well_formed).alias("errors"))


def cardinality(rows: DataFrame, category: str, entry: str, missing: Column) -> DataFrame:
    """Of each category and number of missing turns: how many entries have so many."""
    return rows.groupBy(category, entry).agg(F.count_if(missing).alias("missing")).groupBy(category, "missing").agg(F.count("*").alias("entries"))


def code_ratios(rows: DataFrame, code: str, codes: list[int], keys: list[str], terminal: Column) -> DataFrame:
    """Share of each code among all, and of groups that hold a terminal code."""
    closed = rows.groupBy(*keys).agg(F.max(terminal.cast("int")).alias("c")).agg(F.avg("c").alias("closure_rate"))
    return rows.agg(*[F.avg((F.col(code) == c).cast("double")).alias(f"ratio_{c}") for c in codes]).crossJoin(F.broadcast(closed))  # one row each


def queue_depth(seeds: DataFrame, finished: DataFrame, key: str, dropped: Column) -> DataFrame:
    """Total, succeeded, dropped and pending entries of a queue."""
    ends = finished.select(key, dropped.alias("_d")).groupBy(key).agg(F.max("_d").alias("_d"))
    return seeds.select(key).distinct().join(ends, key, "left").agg(
        F.count("*").alias("total"), F.count_if(F.col("_d") == F.lit(False)).alias("succeeded"), F.count_if("_d").alias("dropped"), F.count_if(F.col("_d").isNull()).alias("pending"))


def flops(rows: DataFrame, length: str, seconds: float, parameters: int, layers: int, heads: int, head_dim: int) -> DataFrame:
    """Achieved TFLOPS of a dense decoder: six operations a parameter and token, twelve a squared length, head and layer."""
    total = 6.0 * parameters * F.sum(F.col(length).cast("double")) + 12.0 * layers * heads * head_dim * F.sum(F.col(length).cast("double") * F.col(length))
    return rows.agg((total / seconds / 1e12).alias("tflops"))


def zero_schema(rows: DataFrame, names: list[str]) -> DataFrame:
    """A metric table with every listed column, zero where it is absent or null."""
    return rows.select(*[(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in rows.columns else F.lit(0.0)).alias(n) for n in names])


def checkpoint_means(rows: DataFrame, checkpoint: str, measures: list[str], text_length: str) -> DataFrame:
    """Means of the measures by checkpoint, with mean and largest output length."""
    return rows.groupBy(checkpoint).agg(*[F.avg(m).alias(f"mean_{m}") for m in measures], F.avg(text_length).alias("length_mean"), F.max(text_length).alias("length_max"))


def evaluation(rows: DataFrame, category: str, progress: Column, complete: Column) -> DataFrame:
    """Progress percent and complete-episode accuracy of each category and of all (category null)."""
    return rows.groupingSets([[F.col(category)], []], F.col(category)).agg(F.count("*").alias("episodes"), (100 * F.avg(progress)).alias("progress_percent"), (100 * F.avg(complete.cast("double"))).alias("accuracy"))


def overall_score(scores: Column) -> Column:
    """Passed turns among all turns; turns without an expectation (negative) stay in the denominator."""
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.greatest(s, F.lit(0.0))) / F.size(scores)).otherwise(F.lit(0.0))


