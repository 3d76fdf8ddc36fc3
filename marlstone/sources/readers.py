"""Readers and writers of rollout logs: strict and tolerant JSON lines, keyed logs, metric logs, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strict_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """JSON lines of a fixed schema; a bad line fails the read, blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def tolerant_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with ``bad``: the text of a line that doesn't parse, else null."""
    return spark.read.schema(f"{schema}, bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad").json(path)


def last_per_key(spark: SparkSession, path: str, schema: str, key: str, version: str) -> DataFrame:
    """The row of the greatest ``version`` of each key."""
    rows = strict_jsonl(spark, path, schema)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(version)))).where("_n = 1").drop("_n")


def metric_log(spark: SparkSession, path: str) -> DataFrame:
    """step, metric, value of log lines ``step:N - k:v - k:v``; terminal colours are stripped and a step's last line counts (files in the order of their names)."""
    at = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    lines = spark.read.text(path).select(F.regexp_replace("value", "\u001b\\[[0-9;]*m", "").alias("line"), at.alias("at"))
    steps = lines.select(F.regexp_extract("line", r"\bstep:([0-9]+)", 1).alias("step"), "line", "at").where("step != ''").groupBy(F.col("step").cast("int").alias("step")).agg(F.max_by("line", "at").alias("line"))
    pairs = F.regexp_extract_all("line", F.lit(r"([A-Za-z_][\w/@.()-]*):(-?[0-9][0-9.eE+-]*)"), F.lit(0))
    long = steps.select("step", F.explode(pairs).alias("pair")).select("step", F.substring_index("pair", ":", 1).alias("metric"), F.substring_index("pair", ":", -1).try_cast("double").alias("value"))
    return long.where("metric != 'step' AND value IS NOT NULL")


def telemetry(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """ts and numeric fields of comma-separated samples; rows of another width or without a time are dropped."""
    parts = F.split("value", r"\s*,\s*")
    rows = spark.read.text(path).select(parts.alias("p")).where(F.size("p") == len(fields) + 1)
    return rows.select(F.try_to_timestamp(F.element_at("p", 1)).alias("ts"), *[F.regexp_extract(F.element_at("p", k + 2), r"-?[0-9.]+(?:[eE][-+]?[0-9]+)?", 0).try_cast("double").alias(f) for k, f in enumerate(fields)]).where("ts IS NOT NULL")


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON text, columns in sorted order."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    rows.select(*[(F.to_json(c) if isinstance(rows.schema[c].dataType, nested) else F.col(c)).alias(c) for c in sorted(rows.columns)]).write.mode("overwrite").csv(path, header=True)


def append_new(held: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key isn't held yet, one for each key: an idempotent append's input."""
    return new.dropDuplicates([key]).join(held.select(key).distinct(), key, "left_anti")


def markdown(rows: DataFrame, columns: list[str]) -> str:
    """A small report as a Markdown table; null as N/A. For results of a few rows: they go to the driver."""
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join("N/A" if v is None else str(v) for v in r) + " |" for r in rows.select(*columns).toLocalIterator()])
