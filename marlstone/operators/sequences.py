"""Conversations as token sequences with loss masks, and sequences in batches of a fixed size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def white_space(text: Column) -> Column:
    """Words of a text; none of null."""
    return F.coalesce(F.filter(F.split(text, r"\s+"), lambda x: x != ""), F.array().cast("array<string>"))


def conversation_tokens(rows: DataFrame, keys: list[str], order: str, role: str, text: str, tokens: Callable[[Column], Column] = white_space, trained: tuple[str, ...] = ("assistant",), header: str = "<|{}|>", end: str = "<|end|>") -> DataFrame:
    """keys, tokens, mask of each conversation, its messages in order.

    A message is its role's header, its tokens and an end; the mask is 1 for the tokens and ends of trained roles, 0
    for headers and all else. ``tokens`` makes an array of a text (a tokenizer's function, or words).
    """
    first, last = header.split("{}")
    head = F.array(F.concat(F.lit(first), F.coalesce(role, F.lit("")), F.lit(last)))
    learns = F.coalesce(F.col(role).isin(*trained), F.lit(False)).cast("int")
    body = F.concat(tokens(F.col(text)), F.array(F.lit(end)))
    parts = rows.select(*keys, F.struct(F.col(order).alias("at"), F.concat(head, body).alias("t"), F.concat(F.array(F.lit(0)), F.array_repeat(learns, F.size(body))).alias("m")).alias("_p"))
    held = parts.groupBy(*keys).agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    return held.select(*keys, F.flatten("_p.t").alias("tokens"), F.flatten("_p.m").alias("mask"))


def fixed_batches(rows: DataFrame, columns: list[str], size: int) -> DataFrame:
    """Each row's sequences in runs of ``size``, numbered by ``batch``; the last run is as long as what is left, an empty sequence has none."""
    n = F.size(columns[0])
    numbers = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
    cut = rows.withColumn("batch", F.explode(numbers))
    return cut.withColumns({c: F.slice(F.col(c), F.col("batch") * size + 1, size) for c in columns})
