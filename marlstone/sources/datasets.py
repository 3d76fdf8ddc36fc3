"""Training files as tables: prompts, preference pairs, conversations, catalogs, recorded responses, and what is known about files."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..operators.nested import parsed_json
from ..operators.rows import numbered


def prompts(spark: SparkSession, *paths: str) -> DataFrame:
    """Parquet files one below the other; files of another schema raise."""
    schemas = {p: spark.read.parquet(p).schema for p in paths}  # footers only
    first = schemas[paths[0]]
    plain = lambda s: [(f.name, f.dataType) for f in s]
    if other := [p for p, s in schemas.items() if plain(s) != plain(first)]:
        raise ValueError(f"{', '.join(other)}: not the columns of {paths[0]}")
    return spark.read.schema(first).parquet(*paths)


def _has(rows: DataFrame, *columns: str) -> None:
    if missing := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"no column {', '.join(missing)}")


def inner(column: str, keys: Sequence[str] = ()) -> Column:
    """A value inside a column of structs or maps, key by key; null where a key is missing in a map."""
    return reduce(lambda c, k: c[k], keys, F.col(column))


def prompt_responses(rows: DataFrame, prompt: str = "prompt", response: str = "response", prompt_keys: Sequence[str] = (), response_keys: Sequence[str] = ()) -> DataFrame:
    """prompt and response as text, each drilled down through nested keys."""
    _has(rows, prompt, response)
    return rows.select(inner(prompt, prompt_keys).cast("string").alias("prompt"), inner(response, response_keys).cast("string").alias("response"))


def preference_pairs(rows: DataFrame, prompt: str = "prompt", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """prompt, chosen, rejected; further columns are not read."""
    _has(rows, prompt, chosen, rejected)
    return rows.select(F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected"))


def conversations(rows: DataFrame, messages: str = "messages", tools: str = "tools", thinking: str = "enable_thinking") -> DataFrame:
    """messages (an array of structs with role and content), tools (JSON text), thinking; the last two are null where the files don't have them."""
    _has(rows, messages)
    kind = rows.schema[messages].dataType
    if not (isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and {"role", "content"} <= set(kind.elementType.names)):
        raise ValueError(f"{messages} holds no messages of role and content")
    given = lambda c, t: F.col(c).cast(t) if c in rows.columns and not isinstance(rows.schema[c].dataType, ArrayType | StructType) else F.to_json(c) if c in rows.columns else F.lit(None).cast(t)
    return rows.select(F.col(messages).alias("messages"), given(tools, "string").alias("tools"), given(thinking, "boolean").alias("thinking"))


def whitespace_tokens(text: Column) -> Column:
    """How many words of a text white space parts; 0 of null."""
    return F.coalesce(F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")), F.lit(0))


def within_length(rows: DataFrame, text: Column, most: int, tokens=whitespace_tokens) -> DataFrame:
    """Rows whose text has ``most`` tokens at most; ``tokens`` counts them (a Column to a Column)."""
    return rows.where(tokens(text) <= most)


def labelled(rows: DataFrame, label: str = "label") -> DataFrame:
    """Rows with a label that isn't empty."""
    return rows.where(F.length(label) > 0)


def json_records(spark: SparkSession, *paths: str, strict: bool = True) -> DataFrame:
    """file, place (from 0), record (JSON text) of files that each hold one JSON value, an array of them, or lines of them.

    A file is read whole, so it must fit a task. What is no object raises; if not ``strict``, it is left out.
    """
    files = spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value", parsed_json(F.col("value")).alias("whole"))
    listed = F.when(F.schema_of_variant("whole").startswith("ARRAY"), F.col("whole").cast("array<variant>")).otherwise(F.array("whole"))
    lines = F.transform(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != ""), parsed_json)
    found = files.select("file", F.posexplode(F.when(F.col("whole").isNotNull(), listed).otherwise(lines)).alias("place", "v"))
    good = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    record = F.when(good, F.to_json("v"))
    if not strict:
        return found.where(good).select("file", "place", record.alias("record"))
    bad = F.raise_error(F.concat(F.lit("no JSON object at "), "file", F.lit(":"), F.col("place").cast("string")))
    return found.select("file", "place", F.coalesce(record, bad.cast("string")).alias("record"))


def asset_checks(spark: SparkSession, assets: Sequence[tuple[str, str | None, int | None]]) -> DataFrame:
    """path, status of files that ought to be there: (path, SHA-256 or null, Parquet rows or null).

    status: missing, digest (another content), rows (another number by the footers) or ok. The list is a
    contract's, a few files; contents are hashed in tasks.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = [p for p, _, _ in assets if (at := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(at)]
    wanted = spark.createDataFrame([(p, d, n, spark.read.parquet(p).count() if n is not None and p in there else None, p in there) for p, d, n in assets], "path string, digest string, rows long, found long, there boolean")
    asked = [p for p, d, _ in assets if d and p in there]
    found = spark.read.format("binaryFile").load(asked).select(F.regexp_replace("path", "^[a-z]+:/+", "/").alias("p"), F.sha2("content", 256).alias("sha")) if asked else spark.createDataFrame([], "p string, sha string")
    both = wanted.join(found, F.regexp_replace("path", "^[a-z]+:/+", "/") == F.col("p"), "left")
    status = F.when(~F.col("there"), "missing").when(F.col("digest").isNotNull() & ~F.lower("digest").eqNullSafe(F.col("sha")), "digest").when(F.col("rows").isNotNull() & ~F.col("rows").eqNullSafe(F.col("found")), "rows").otherwise("ok")
    return both.select("path", status.alias("status"))


def cursors(rows: DataFrame, role: str, order: list[str], out: str = "cursor") -> DataFrame:
    """Adds a row's place among those of its role, from 0; a global order by ranges, no role in one task."""
    placed = numbered(rows, [role, *order], "_nth")
    starts = placed.groupBy(F.col(role).alias("_role")).agg(F.min("_nth").alias("_start"))
    return placed.join(F.broadcast(starts), F.col(role).eqNullSafe(F.col("_role"))).withColumn(out, F.col("_nth") - F.col("_start")).drop("_nth", "_role", "_start")  # a row for each role


def recorded(records: DataFrame, record: str = "record") -> DataFrame:
    """file, place, role, text of recorded responses (text, else response); a record without them raises."""
    role, text = F.get_json_object(record, "$.role"), F.coalesce(F.get_json_object(record, "$.text"), F.get_json_object(record, "$.response"))
    bad = F.raise_error(F.concat(F.lit("invalid replay record at "), "file", F.lit(":"), F.col("place").cast("string"))).cast("string")
    return records.select("file", "place", F.coalesce(role, bad).alias("role"), F.coalesce(text, bad).alias("text"))


def replayed(requests: DataFrame, responses: DataFrame, role: str, order: list[str], recorded_order: list[str]) -> DataFrame:
    """Requests with ``text``: the n-th request of a role gets its n-th recorded response, null beyond the last."""
    asked = cursors(requests, role, order)
    given = cursors(responses.select(role, "text", *recorded_order), role, recorded_order).select(role, "cursor", "text")
    return asked.drop("text").join(given, [role, "cursor"], "left")


def with_side_columns(batch: DataFrame, sides: dict[str, DataFrame], row: str) -> DataFrame:
    """A batch with those side columns (tables of ``row`` and ``value``) that have as many rows as the batch."""
    sizes = {name: side.count() for name, side in sides.items()}  # a job for each named column
    n = batch.count()
    return reduce(lambda b, x: b.join(sides[x].select(row, F.col("value").alias(x)), row, "left"), [x for x, size in sizes.items() if size == n], batch)


def united_by_keys(parts: Sequence[DataFrame]) -> DataFrame:
    """Tables one below the other under the sorted union of their columns, as text; what a table lacks is empty."""
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [p.select([F.col(f"`{c}`").cast("string") for c in p.columns]) for p in parts])
    return whole.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in sorted(whole.columns)])
