"""Rows for training built from raw tables, written splits with manifests, and what a file's profile says."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rows import numbered

# Fixed value: what a question ends with.
STEP_BY_STEP = 'Let\'s think step by step and output the final answer after "####".'


def training_rows(rows: DataFrame, order: list[str], source: Column | str, question: Column, truth: Column, ability: str, split: str, style: str = "rule", instruction: str | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """data_source, prompt (one user message), ability, reward_model (style, ground_truth), extra_info (split, index, further values).

    index numbers the rows in ``order`` from 0, dealt by range.
    """
    extra = extra or {}
    placed = numbered(rows.withColumn("_q", question).withColumn("_t", truth).withColumns({f"_x{k}": v for k, v in enumerate(extra.values())}).withColumn("_s", source if isinstance(source, Column) else F.lit(source)), order, "_nth")
    asked = F.concat_ws(" ", "_q", F.lit(instruction)) if instruction else F.col("_q")
    info = F.struct(F.lit(split).alias("split"), F.col("_nth").alias("index"), *[F.col(f"_x{k}").alias(n) for k, n in enumerate(extra)])
    return placed.select(F.col("_s").alias("data_source"), F.array(F.struct(F.lit("user").alias("role"), asked.alias("content"))).alias("prompt"), F.lit(ability).alias("ability"), F.struct(F.lit(style).alias("style"), F.col("_t").alias("ground_truth")).alias("reward_model"), info.alias("extra_info"))


def marked_solution(answer: Column) -> Column:
    """The number behind #### without separators; raises where there is none."""
    found = F.regexp_extract(answer, r"#### (-?[0-9.,]+)", 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit(""))).otherwise(F.raise_error(F.lit("an answer without ####")).cast("string"))


def supervised_rows(pairs: DataFrame) -> DataFrame:
    """prompt, response: of each preference pair a row for the chosen and one for the rejected answer."""
    return pairs.select("prompt", F.explode(F.array("chosen", "rejected")).alias("response"))


def search_rows(rows: DataFrame, order: list[str], split: str, tag: str = "searchR1_", system: str = "") -> DataFrame:
    """Search questions as training rows: the source behind a tag; the truth of reward_model, else golden_answers.

    ``rows``: data_source, question, reward_model.ground_truth and golden_answers (arrays; either may be null).
    """
    truth = F.coalesce("reward_model.ground_truth", "golden_answers", F.array().cast("array<string>"))
    question = F.coalesce("question", F.lit(""))
    out = training_rows(rows, order, F.concat(F.lit(tag), F.coalesce("data_source", F.lit(""))), question, truth, "fact-reasoning", split, extra={"question": question})
    return out.withColumn("prompt", F.concat(F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content"))), "prompt")) if system else out


def write_splits(splits: dict[str, DataFrame], folder: str) -> DataFrame:
    """Each split as Parquet below ``folder`` and the manifest (split, path, rows, columns), which is written there as JSON too."""
    spark = next(iter(splits.values())).sparkSession
    listed = []
    for name, rows in splits.items():  # a job each
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        listed.append((name, f"{folder}/{name}", spark.read.parquet(f"{folder}/{name}").count(), rows.columns))
    manifest = spark.createDataFrame(listed, "split string, path string, rows long, columns array<string>")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def dumped(rows: DataFrame, folder: str, keys: tuple[str, ...] = ("epoch", "global_step")) -> None:
    """Rollouts or update records appended below folders of their epoch and step; a step that is dumped again replaces its own rows alone."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(folder)


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """file, total, valid, errors (places of the first ones, from 1) of JSON-lines files, line by line; blank lines don't count."""
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).where(F.trim("line") != "")
    good = F.coalesce(F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT"), F.lit(False))
    errors = F.slice(F.array_sort(F.collect_list(F.when(~good, F.col("at") + 1))), 1, 20)
    return whole.groupBy("file").agg(F.count("*").alias("total"), F.count_if(good).alias("valid"), errors.alias("errors"))


def profile(rows: DataFrame, counted: list[str], ids: list[Column]) -> DataFrame:
    """column, value, rows: totals, distinct ids (the first of ``ids`` that isn't null) and the counts of each value of the named columns, null among them."""
    whole = rows.agg(F.count("*").alias("rows"), F.count_distinct(F.coalesce(*ids)).alias("ids"))
    total = whole.select(F.inline(F.array(*[F.struct(F.lit(n).alias("column"), F.lit(None).cast("string").alias("value"), F.col(n).alias("rows")) for n in ("rows", "ids")])))
    parts = [rows.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("rows")).select(F.lit(c).alias("column"), "value", "rows") for c in counted]
    return reduce(DataFrame.unionByName, parts, total)


def appended(held: DataFrame, new: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, counts): new rows whose key isn't held, one for each key, and how many were accepted and how many were not."""
    fresh = new.dropDuplicates([key]).join(held.select(key).distinct(), key, "left_anti").select(new.columns)
    counts = new.agg(F.count("*").alias("_all")).join(F.broadcast(fresh.agg(F.count("*").alias("accepted"))))  # one row each
    return fresh, counts.select("accepted", (F.col("_all") - F.col("accepted")).alias("duplicates"))
