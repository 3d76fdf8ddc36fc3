"""Batches as DataFrames: column groups, joins by key with checks, reordering, chunks, unions and line tools."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rows import held


def popped(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the columns, what is left); a column that isn't there raises."""
    unknown = [c for c in columns if c not in rows.columns]
    if unknown:
        raise KeyError(f"no such columns: {unknown}")
    return rows.select(*columns), rows.drop(*columns)


def renamed(rows: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    """Columns by new names; lists of unequal length raise."""
    if len(old) != len(new):
        raise ValueError(f"{len(old)} names for {len(new)} columns")
    return rows.withColumnsRenamed(dict(zip(old, new, strict=True)))


def item(rows: DataFrame, row: str, at: int | slice | list[int] | Column) -> DataFrame:
    """Rows by number, slice, list of numbers (order and repeats kept in ``pos``) or boolean mask."""
    if isinstance(at, int):
        return rows.where(F.col(row) == at)
    if isinstance(at, slice):
        step, start = at.step or 1, at.start or 0
        inside = (F.col(row) >= start) & ((F.col(row) - start) % step == 0)
        return rows.where(inside if at.stop is None else inside & (F.col(row) < at.stop))
    if isinstance(at, Column):
        return rows.where(at)
    wanted = rows.sparkSession.createDataFrame(list(enumerate(at)), f"pos int, {row} long")
    return rows.join(F.broadcast(wanted), row)


def columns_of(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each group's rows as one row of lists in order."""
    others = [c for c in rows.columns if c not in [*keys, order]]
    held = F.array_sort(F.collect_list(F.struct(order, *others)))  # a batch's rows: bounded by the batch size
    return rows.groupBy(*keys).agg(held.alias("_h")).select(*keys, *[F.col(f"_h.{c}").alias(c) for c in [order, *others]])


def checked_id(*candidates: Column) -> Column:
    """The first id that is there and not empty; a row without one raises."""
    found = F.coalesce(*[F.when(F.length(c.cast("string")) > 0, c.cast("string")) for c in candidates])
    return F.when(found.isNull(), F.raise_error(F.lit("row without an id")).cast("string")).otherwise(found)


def held_out(rows: DataFrame, trained: DataFrame, key: str) -> DataFrame:
    """Rows whose key was not trained on."""
    return rows.join(trained.select(key), key, "left_anti")


def selected(rows: DataFrame, **equal) -> DataFrame:
    """Rows equal to all of the given values; none at all raises."""
    found = rows.where(" AND ".join(["true", *[f"`{c}` <=> {_literal(v)}" for c, v in equal.items()]]))
    if found.isEmpty():
        raise ValueError(f"no rows with {equal}")
    return found


def _literal(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def within(value: Column, low, high) -> Column:
    """A closed range in which a missing value counts as zero."""
    return F.coalesce(value, F.lit(0)).between(low, high)


def between_dates(text: Column, start: str | None, end: str | None) -> Column:
    """Text times in a closed range that may be open at either end."""
    at = text.try_cast("timestamp")
    return (at >= F.lit(start or "0001-01-01").cast("timestamp")) & (at <= F.lit(end or "9999-12-31").cast("timestamp"))


def percent_change(new: Column, old: Column, digits: int = 2) -> Column:
    """Change in percent of the old value; null where that is zero."""
    return F.round((new - old) * 100 / F.nullif(old, F.lit(0.0)), digits)


def changed(rows: DataFrame, keys: list[str], name: str, change: Column, threshold: float) -> DataFrame:
    """For each key the names whose absolute change reaches a threshold, in order, as one text."""
    over = F.array_sort(F.collect_list(F.when(F.abs(change) >= threshold, F.col(name).cast("string"))))
    return rows.groupBy(*keys).agg(F.array_join(over, ", ").alias("changed"))


def matches_text_or_tag(text: Column, tags: Column, keyword: str) -> Column:
    """A case-insensitive part of the text, or one of the tags."""
    return F.contains(F.lower(text), F.lit(keyword.lower())) | F.array_contains(F.transform(tags, F.lower), keyword.lower())


def contains_text(text: Column, part: str) -> Column:
    return F.contains(F.lower(text), F.lit(part.lower()))


def owned(rows: DataFrame, owner: str, name, status: str | None = None, wanted: str | None = None) -> DataFrame:
    """Rows of an owner, with a status if one is asked for (case-insensitive)."""
    found = rows.where(F.col(owner) == name)
    return found if wanted is None else found.where(F.lower(status) == wanted.lower())


def found_under(rows: DataFrame, path: str, name: str) -> DataFrame:
    """Paths whose last part contains a name."""
    return rows.where(F.contains(F.element_at(F.split(path, "/"), -1), F.lit(name)))


def bucketed(text: Column, buckets: list[tuple[str, str]], otherwise: str) -> Column:
    """The bucket of the first part, in order, that a text contains (case-insensitive)."""
    out = None
    for part, bucket in buckets:
        hit = F.contains(F.lower(text), F.lit(part.lower()))
        out = F.when(hit, bucket) if out is None else out.when(hit, bucket)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def ended_by(text: Column, endings: list[tuple[str, str]], otherwise: str) -> Column:
    """How a text ended, by its last characters but white space."""
    out = None
    for ending, name in endings:
        hit = F.endswith(F.rtrim(text), F.lit(ending))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def merged_columns(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of both for each key; a shared column must be equal on both sides, else the row raises."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    right = b.withColumnsRenamed({c: f"_{c}" for c in shared})
    same = F.lit(True)
    for c in shared:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = a.join(right, key)
    checked = F.when(same, F.col(key)).otherwise(F.raise_error(F.lit(f"columns differ: {shared}")).cast(a.schema[key].dataType))
    return joined.withColumn(key, checked).drop(*[f"_{c}" for c in shared])


def in_all(rows: DataFrame, keys: list[str], model: str, models: list[str], value: str) -> DataFrame:
    """One row for each key that every model has, the models' values as columns."""
    wide = rows.groupBy(*keys).agg(*[F.max(F.when(F.col(model) == m, F.col(value))).alias(m) for m in models])
    return wide.dropna(subset=models)


def records(raw: DataFrame, gold: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Raw rows with their gold row (required) and what a third table knows of them."""
    return raw.join(gold, key).join(extra, key, "left")


#: Characters of a phrase by which it is looked up.
GRAM = 8


def identified(rows: DataFrame, catalog: DataFrame, row: str, text: str, entry: str, phrase: str) -> DataFrame:
    """row, entry of the texts that contain exactly one entry's phrase, at any size of the catalog.

    A phrase is looked up by its first characters (GRAM at most) among the texts' pieces of that length, then held
    against the whole text. Empty phrases and null ones are in no text. The pieces are many times their texts, so
    they are never broadcast, whatever the texts' size is taken for.
    """
    listed = catalog.where(F.length(phrase) > 0).select(entry, phrase, F.substring(phrase, 1, GRAM).alias("_gram"))
    lengths = sorted(r[0] for r in listed.select(F.length("_gram")).distinct().collect())  # GRAM numbers at most
    if not lengths:
        return rows.join(listed, F.lit(False)).select(row, entry)
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda k: F.substring(F.col(text), k, F.lit(n)))
    grams = F.concat(*[F.when(F.length(text) >= n, pieces(n)).otherwise(F.array().cast("array<string>")) for n in lengths])
    asked = rows.select(row, text, F.explode(F.array_distinct(grams)).alias("_gram"))
    found = asked.join(listed.hint("merge"), "_gram").where(F.contains(F.col(text), F.col(phrase)))
    return found.groupBy(row).agg(F.min(entry).alias(entry), F.countDistinct(entry).alias("_n")).where("_n = 1").select(row, entry)


def preferring_local(rows: DataFrame, catalog: DataFrame, keys: list[str], place: str, value: str) -> DataFrame:
    """Rows with the catalog's value of their keys: the local one, else the only one elsewhere; ``ambiguous`` where there are several."""
    local = catalog.groupBy(*keys, place).agg(F.min(value).alias("_local"))
    anywhere = catalog.groupBy(*keys).agg(F.min(value).alias("_any"), F.countDistinct(value).alias("_n"))
    out = rows.join(local, [*keys, place], "left").join(anywhere, keys, "left")
    out = out.withColumn(value, F.coalesce("_local", F.when(F.col("_n") == 1, F.col("_any")))).withColumn("ambiguous", F.col("_local").isNull() & (F.coalesce("_n", F.lit(0)) > 1))
    return out.drop("_local", "_any", "_n")


def is_subsequence(part: Column, whole: Column) -> Column:
    """Whether the first list occurs in the second in order, gaps allowed."""
    return F.aggregate(whole, F.lit(0), lambda k, x: k + F.when(F.get(part, k).eqNullSafe(x) & (k < F.size(part)), 1).otherwise(0)) == F.size(part)


def state_differences(model: DataFrame, gold: DataFrame, keys: list[str], attribute: str, value: str) -> DataFrame:
    """Attributes of the gold state that the model's state lacks or holds with another value."""
    held = model.select(*keys, attribute, F.col(value).alias("model"), F.lit(True).alias("_there"))
    out = gold.select(*keys, attribute, F.col(value).alias("gold")).join(held, [*keys, attribute], "left")
    return out.where(F.col("_there").isNull() | ~F.col("gold").eqNullSafe(F.col("model"))).drop("_there")


def line_differences(a: DataFrame, b: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 0), left, right: lines that differ at the same place, up to the shorter text's end."""
    lines = lambda df, name: df.select(key, F.posexplode(F.split(text, "\n")).alias("line", name))
    return lines(a, "left").join(lines(b, "right"), [key, "line"]).where(~F.col("left").eqNullSafe(F.col("right")))


def consumers(calls: DataFrame, group: str, call: str, needs: str) -> DataFrame:
    """group, producer, consumers: the calls that depend on each call."""
    edges = calls.select(group, F.col(call).alias("consumer"), F.explode(needs).alias("producer"))
    return edges.groupBy(group, "producer").agg(F.array_sort(F.collect_set("consumer")).alias("consumers"))


def looked_up(rows: DataFrame, catalog: DataFrame, key: str, value: str) -> DataFrame:
    """Rows with the catalog's value of their key; an unknown key raises."""
    out = rows.join(catalog.select(key, value), key, "left")
    return out.withColumn(value, F.when(F.col(value).isNull(), F.raise_error(F.concat(F.lit("unknown "), F.col(key).cast("string"))).cast(catalog.schema[value].dataType)).otherwise(F.col(value)))


def repaired_status(candidates: DataFrame, tracked: DataFrame, key: str) -> DataFrame:
    """Tracked rows, with status SUCCEEDED where a candidate shows that they have."""
    done = candidates.select(key).distinct().withColumn("_done", F.lit(True))
    return tracked.join(done, key, "left").withColumn("status", F.when(F.col("_done"), "SUCCEEDED").otherwise(F.col("status"))).drop("_done")


def reordered(rows: DataFrame, row: str, permutation: DataFrame) -> DataFrame:
    """Rows by the places (pos) that a permutation (pos, row) gives them, sorted."""
    return rows.join(permutation.select("pos", row), row).orderBy("pos")


def inverse(permutation: DataFrame, row: str) -> DataFrame:
    """The permutation that undoes one: pos and row exchanged."""
    return permutation.select(F.col(row).alias("pos"), F.col("pos").alias(row))


def folded(rows: DataFrame, row: str, size: int, values: list[str]) -> DataFrame:
    """bucket and lists of values: ``size`` rows that follow one another as one."""
    held = F.array_sort(F.collect_list(F.struct(row, *values)))  # size rows
    return rows.groupBy(F.floor(F.col(row) / size).alias("bucket")).agg(held.alias("_h")).select("bucket", *[F.col(f"_h.{v}").alias(v) for v in values])


def unfolded(rows: DataFrame, bucket: str, size: int, values: list[str]) -> DataFrame:
    """What :func:`folded` undoes."""
    out = rows.select(bucket, F.posexplode(F.arrays_zip(*values)).alias("_k", "_v"))
    return out.select((F.col(bucket) * size + F.col("_k")).alias("row_id"), *[F.col(f"_v.{v}").alias(v) for v in values])


def unfolded_chunks(rows: DataFrame, column: str, n: int) -> DataFrame:
    """Each row n times, each with one of the n equal parts of a list column; other columns are repeated."""
    width = F.ceil(F.size(column) / n).cast("int")
    parts = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.slice(F.col(column), k * width + 1, width))
    return rows.select(*[c for c in rows.columns if c != column], F.posexplode(parts).alias("chunk", column))


def with_edge_copies(rows: DataFrame, row: str, copies: int, last: bool = True) -> DataFrame:
    """Rows with copies of the last (or first) one behind them."""
    ends = rows.agg(F.max(row).alias("_last"), F.min(row).alias("_first"))
    edge = rows.join(F.broadcast(ends), F.col(row) == F.col("_last" if last else "_first"))
    more = edge.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(copies)))).withColumn(row, F.col("_last") + F.col("_k")).select(rows.columns)
    return rows.unionByName(more)


def united(parts: Iterable[DataFrame], number: str | None = None, order: list[str] | None = None) -> DataFrame:
    """Tables one after the other by column name; ``number`` adds row numbers from 0 in the given order."""
    from .rows import numbered

    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out if number is None else numbered(out, order, number)


def unique_content(rows: DataFrame, columns: list[str], key: str) -> DataFrame:
    """fingerprint, key: the smallest key of each distinct content (columns by name)."""
    body = F.to_json(F.struct(*sorted(columns)))
    return rows.groupBy(F.sha2(body, 256).alias("fingerprint")).agg(F.min(key).alias(key))


def flattened_calls(rows: DataFrame, keys: list[str], order: str, calls: str) -> DataFrame:
    """All calls of a turn in order, repeats kept, with their place."""
    held = F.array_sort(F.collect_list(F.struct(order, calls)))  # of one turn
    return rows.groupBy(*keys).agg(F.flatten(F.transform(held, lambda h: h[calls])).alias("_c")).select(*keys, F.posexplode("_c").alias("place", "call"))


def last_positions(mask: Column, n: Column) -> Column:
    """The last n entries of a mask."""
    return F.slice(mask, F.greatest(F.size(mask) - n + 1, F.lit(1)), n)


def first_unmasked(values: Column, mask: Column) -> Column:
    """The value at the first unmasked place, 0 where all are masked."""
    at = F.array_position(mask, 1)
    return F.when(at > 0, F.get(values, (at - 1).cast("int"))).otherwise(0)


def covering_parts(assigned: DataFrame, items: DataFrame, key: str, part: str, parts: int) -> DataFrame:
    """One row: whether all parts hold something, all items are in a part, and none twice."""
    used = assigned.agg(F.countDistinct(part).alias("_p"), F.count("*").alias("_n"), F.countDistinct(key).alias("_k"))
    missing = items.join(assigned.select(key), key, "left_anti").agg(F.count("*").alias("_m"))
    return used.crossJoin(F.broadcast(missing)).select((F.col("_p") == parts).alias("all_used"), (F.col("_m") == 0).alias("all_covered"), (F.col("_n") == F.col("_k")).alias("none_twice"))  # one row each


def sampler(rows: DataFrame, key: str, seed: int | None = None) -> DataFrame:
    """Rows by lot with a seed, by key without."""
    from .credit import shuffled

    return rows.orderBy(key) if seed is None else shuffled(rows, key, seed)


def longest_paths(edges: DataFrame, group: str, producer: str, consumer: str) -> DataFrame:
    """group, depth: calls on the longest dependency path, of any length; null where the dependencies have a cycle.

    One join a level: edges from calls that nothing leads to are taken away until a group has none; a group that
    loses none while it still has some has a cycle.
    """
    left = held(edges.select(group, F.col(producer).alias("_from"), F.col(consumer).alias("_to")).distinct())
    ended, level = None, 1
    while True:
        level += 1
        tos = left.select(group, F.col("_to").alias("_from")).distinct()
        kept = held(left.join(tos, [group, "_from"], "left_semi"))
        sizes = left.groupBy(group).agg(F.count("*").alias("_before")).join(kept.groupBy(group).agg(F.count("*").alias("_after")), group, "left")
        done = sizes.where("_after IS NULL").select(group, F.lit(level).alias("depth"))
        stuck = sizes.where("_after = _before").select(group, F.lit(None).cast("int").alias("depth"))
        now = held(done.unionByName(stuck))
        ended = now if ended is None else ended.unionByName(now)
        left = kept.join(now, group, "left_anti")
        if left.isEmpty():
            return ended
