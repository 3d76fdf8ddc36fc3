"""Minimax contiguous partition of ordered groups into shards; DataFrame operations only.

Rows are dealt by range of (group, order) and sorted, so that a large group spans several tasks, and sizes are
summed up within a task's rows and over the tasks before it. A group's end is the largest such sum. The smallest
shard capacity is found by binary search; a capacity is checked greedily: a shard ends at the last group end that
it still reaches. The check knows a bounded number of group ends, and for each stretch between two of them whether
it is empty. While the answer hangs on a stretch that isn't, Spark lists ends inside it, and the search goes on.

A group of more than an even share can't be dealt out and would leave other shards empty: such groups, fewer than
the shards, have a shard of their own, and the rest is partitioned into what remains.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Pieces that a stretch is divided into, in all and each; a piece gives its first and last group end to the driver.
PIECES, LEAST = 2048, 16


def _running(rows: DataFrame, group: list[str], order: list[str], size: str, scratch: Scratch) -> DataFrame:
    """Rows with _upto and _nth: sizes and rows up to and with this one, in the order of (group, order)."""
    dealt = scratch.cut(rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_part", F.spark_partition_id()))
    # a row for each task of the sort
    parts = dealt.groupBy("_part").agg(F.sum(size).alias("b"), F.count("*").alias("n")).orderBy("_part").collect()
    starts, b, n = [], 0, 0
    for p in parts:
        starts.append((p["_part"], b, n))
        b, n = b + p["b"], n + p["n"]
    before = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part int, _b long, _n long"))
    w = Window.partitionBy("_part").orderBy(*group, *order).rowsBetween(Window.unboundedPreceding, 0)
    own = dealt.withColumn("_s", F.sum(size).over(w)).withColumn("_i", F.row_number().over(w))
    return own.join(before, "_part").withColumn("_upto", F.col("_b") + F.col("_s")).withColumn("_nth", (F.col("_n") + F.col("_i")).cast("long")).drop("_part", "_b", "_n", "_s", "_i")


class Known:
    """Group ends that the driver knows, ascending, and for each whether unknown ones lie between it and the one before."""

    def __init__(self, total: int):
        self.ends, self.gap = [0, total], [False, True]

    def learn(self, lo: int, hi: int, pieces: list[tuple[int, int, int]]) -> None:
        """What lies inside (lo, hi), neighbours so far: pieces of (first end, last end, ends), ascending."""
        at, ends, gap = bisect_left(self.ends, hi), [], []
        for first, last, n in pieces:
            ends += [first, last] if last > first else [first]
            gap += [False, n > 2] if last > first else [False]
        self.ends[at:at], self.gap[at : at + 1] = ends, [*gap, False]

    def reach(self, to: int, surely: bool) -> int:
        """The last group end at or before ``to``: one that surely exists, or one that may."""
        at = bisect_right(self.ends, to) - 1
        if surely or at + 1 == len(self.ends) or self.ends[at] == to or not self.gap[at + 1]:
            return self.ends[at]
        return to

    def cuts(self, capacity: int, shards: int, surely: bool) -> list[int]:
        """Where the shards end, greedily; fewer than ``shards`` ends if the total is reached before."""
        made, at = [], 0
        while len(made) < shards and at < self.ends[-1]:
            end = self.reach(at + capacity, surely)
            if end == at:
                break
            made.append(at := end)
        return made

    def least(self, low: int, high: int, shards: int, surely: bool) -> int:
        """The smallest capacity from ``low`` to ``high`` whose shards reach the total; ``high`` does."""
        while low < high:
            middle = (low + high) // 2
            made = self.cuts(middle, shards, surely)
            low, high = (low, middle) if made and made[-1] == self.ends[-1] else (middle + 1, high)
        return low

    def open(self, low: int, high: int, shards: int) -> list[tuple[int, int]]:
        """The stretches with unknown ends that a cut may fall in, at capacities from ``low`` to ``high``."""
        found, least, most = [], 0, 0
        for _ in range(shards):
            least, most = self.reach(least + low, True), self.reach(most + high, False)
            first, last = bisect_right(self.ends, least), min(bisect_left(self.ends, most), len(self.ends) - 1)
            found += [(self.ends[k - 1], self.ends[k]) for k in range(first, last + 1) if self.gap[k]]
        return sorted(set(found))


def _inside(ends: DataFrame, stretches: list[tuple[int, int]]) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
    """Pieces of the group ends inside each stretch; PIECES of them at most where stretches are fewer."""
    per = max(LEAST, PIECES // len(stretches))
    listed = [(k, lo, hi, max(1, -(-(hi - lo) // per))) for k, (lo, hi) in enumerate(stretches)]
    lows, highs, widths = (F.array(*[F.lit(x[j]).cast("long") for x in listed]) for j in (1, 2, 3))
    held = ends.withColumn("k", F.size(F.filter(lows, lambda x: x < F.col("upto"))) - 1)
    held = held.withColumns({"low": F.get(lows, "k"), "high": F.get(highs, "k"), "width": F.get(widths, "k")}).where("upto < high")
    held = held.withColumn("piece", F.floor((F.col("upto") - F.col("low")) / F.col("width")))
    rows = held.groupBy("k", "piece").agg(F.min("upto").alias("a"), F.max("upto").alias("b"), F.count("*").alias("n")).orderBy("k", "piece").collect()
    found: dict[tuple[int, int], list] = {s: [] for s in stretches}
    for r in rows:
        found[stretches[r["k"]]].append((r["a"], r["b"], r["n"]))
    return found


def minimax_cuts(ends: DataFrame, total: int, most: int, shards: int) -> list[int]:
    """The ends of shards of the smallest capacity; ``ends`` has a distinct ``upto`` for each group, ``most`` is the largest group."""
    known = Known(total)
    low, high = max(most, -(-total // shards)), min(total, most + -(-total // shards))
    while True:
        low, high = known.least(low, high, shards, False), known.least(low, high, shards, True) if known.cuts(high, shards, True)[-1:] == [total] else high
        stretches = known.open(low, high, shards)
        if low == high and known.cuts(low, shards, True)[-1:] == [total] or not stretches:
            return known.cuts(high, shards, True)
        # the widest ones first, where they are many
        stretches = sorted(sorted(stretches, key=lambda s: s[0] - s[1])[: PIECES // LEAST])
        for (lo, hi), pieces in _inside(ends, stretches).items():
            known.learn(lo, hi, pieces)


def sharded(rows: DataFrame, shards: int, group: list[str], order: list[str], size: str) -> DataFrame:
    """All columns of ``rows``, ``shard`` and ``slot``: groups stay whole, the largest shard is as small as it can be.

    Groups are the distinct values of ``group`` (null is one of them), in ascending order; the shards are cut from
    that order, and slots number a shard's rows from 0 in the order of (group, order). A group larger than an even
    share of what is left has a shard of its own, the last ones. Sizes are whole and not negative; a null size
    counts as 0. Rows alike in group and order keep no defined order among each other; repeated rows count as rows
    each; an empty table gives an empty one; with few groups some shards stay empty. Columns named shard or slot
    are replaced.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    scratch = Scratch(rows.sparkSession, "sharding")
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    named = rows.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)).alias("_size"))
    keys = [f"_g{k}" for k in range(len(group))], [f"_o{k}" for k in range(len(order))]
    named = named.select("*", *[F.col(f"`{c}`").alias(k) for names, cols in zip(keys, (group, order), strict=True) for k, c in zip(names, cols, strict=True)])
    running = scratch.cut(_running(named, *keys, "_size", scratch))
    groups = scratch.cut(running.groupBy(*keys[0]).agg(F.max("_upto").alias("upto"), F.max("_nth").alias("nth"), F.sum("_size").alias("size"), F.count("*").alias("n")).drop(*keys[0]))
    total = groups.agg(F.sum("size"), F.max("size")).first()
    left, free, alone = total[0] or 0, shards, []
    while free > 1:  # groups over an even share; each pass lowers what an even share is
        over = groups.where((F.col("size") * free > left) & ~F.col("nth").isin([r["nth"] for r in alone])).collect() if left else []  # fewer than free, or their sizes were more than is left
        if not over:
            break
        alone += over
        left, free = left - sum(r["size"] for r in over), free - len(over)
    alone.sort(key=lambda r: r["nth"])
    shift = lambda at, field: reduce(lambda a, r: a - F.when(F.col(at) >= r["nth"], r[field]).otherwise(0), alone, F.lit(0))
    rest = groups.where(~F.col("nth").isin([r["nth"] for r in alone])).select((F.col("upto") + shift("nth", "size")).alias("upto"), (F.col("nth") + shift("nth", "n")).alias("nth"), "size")
    rest = scratch.cut(rest.groupBy("upto").agg(F.max("nth").alias("nth"), F.max("size").alias("size"))) if left else rest
    largest = rest.agg(F.max("size")).first()[0] or 0
    cuts = minimax_cuts(rest.select("upto"), left, largest, free) if left else []
    at_rows = sorted(r["nth"] for r in rest.where(F.col("upto").isin(cuts)).select("nth").collect())  # a row for each shard
    own = reduce(lambda a, k: F.when(F.col("_nth").between(alone[k]["nth"] - alone[k]["n"] + 1, alone[k]["nth"]), k).otherwise(a), range(len(alone)), F.lit(-1))
    placed = running.withColumn("_own", own).withColumn("_rest", F.col("_nth") + shift("_nth", "n"))
    inner = at_rows[:-1]
    placed = placed.withColumn("_shard", sum([(F.col("_rest") > c).cast("int") for c in inner], F.lit(0)))
    starts, own_starts = (F.array(*[F.lit(x).cast("long") for x in [*xs, 0]]) for xs in ([0, *inner], [r["nth"] - r["n"] for r in alone]))
    slot = F.when(F.col("_own") >= 0, F.col("_nth") - F.get(own_starts, "_own")).otherwise(F.col("_rest") - F.get(starts, "_shard")) - 1
    return placed.select(*[F.col(f"`{c}`") for c in kept], F.when(F.col("_own") >= 0, F.col("_own") + free).otherwise(F.col("_shard")).cast("int").alias("shard"), slot.cast("long").alias("slot"))


def measured(docs: DataFrame, doc: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes and 8), text_crc32 (null without a text), key (SHA-256 of the text, null without one)."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{doc}`").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("key"))


def documents_in_shards(docs: DataFrame, shards: int, doc: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law (bytes), shard, slot, grown_shard (null: another number of shards is another partition).

    Documents of equal text are a group; the groups are ordered by their texts' digests. Texts themselves aren't
    shuffled. Null texts are a group of rows of 8 bytes. Whole texts of any length count; see ``sharded``.
    """
    scratch = Scratch(docs.sparkSession, "sharding")
    rows = scratch.cut(measured(docs, doc, text_col))
    placed = sharded(rows, shards, ["key"], ["doc_id"], "size")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_in_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), 24)


#: The capacity by binary search, a greedy step of a check in each round of the recursion.
SQL = r"""
WITH RECURSIVE codes AS (SELECT [list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) FOR i IN range(256)] AS t),
docs AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0) + 8 AS size, sha256(text) AS k, CASE WHEN text IS NULL THEN NULL ELSE xor(4294967295, list_reduce(
    list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: CAST('0x' || p AS BIGINT)), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8), CAST(4294967295 AS BIGINT))) END AS crc FROM documents, codes),
groups AS (SELECT k, CAST(sum(size) AS BIGINT) AS size, count(*) AS n FROM docs GROUP BY k),
ranked AS (SELECT *, row_number() OVER (ORDER BY size DESC, k) AS j, sum(size) OVER (ORDER BY size DESC, k ROWS UNBOUNDED PRECEDING) - size AS b, sum(size) OVER () AS t FROM groups),
alone AS (SELECT k, size, n, row_number() OVER (ORDER BY k NULLS FIRST) - 1 AS own FROM ranked WHERE j < (SELECT coalesce(min(j), 24) FROM ranked WHERE size * (25 - j) <= t - b OR j >= 24)),
free AS (SELECT 24 - count(*) AS n FROM alone),
ordered AS (SELECT k, size, n, CAST(sum(size) OVER (ORDER BY k NULLS FIRST ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM groups WHERE NOT EXISTS (SELECT 1 FROM alone WHERE alone.k IS NOT DISTINCT FROM groups.k)),
total AS (SELECT CAST(sum(size) AS BIGINT) AS t, max(size) AS most FROM ordered),
search AS (SELECT greatest(most, (t + n - 1) // n) AS lo, t AS hi, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS s FROM total, free
  UNION ALL SELECT CASE WHEN nx < t AND s + 1 = n THEN mid + 1 ELSE lo END, CASE WHEN nx = t THEN mid ELSE hi END, CASE WHEN nx = t OR s + 1 = n THEN 0 ELSE nx END, CASE WHEN nx = t OR s + 1 = n THEN 0 ELSE s + 1 END
  FROM (SELECT lo, hi, (lo + hi) // 2 AS mid, s, max(upto) AS nx FROM search JOIN ordered ON upto <= pos + (lo + hi) // 2 WHERE lo < hi GROUP BY lo, hi, pos, s), total, free),
least AS (SELECT lo AS c FROM search WHERE lo = hi),
cuts AS (SELECT CAST(0 AS BIGINT) AS a, CAST(-1 AS BIGINT) AS shard, CAST(0 AS BIGINT) AS z FROM least
  UNION ALL SELECT z, shard + 1, max(upto) FROM cuts, least JOIN ordered ON true WHERE upto <= z + c AND z < (SELECT t FROM total) GROUP BY a, z, shard, c),
placed AS (SELECT k, shard FROM ordered JOIN cuts ON upto > a AND upto <= z UNION ALL SELECT k, own + free.n FROM alone, free)
SELECT doc_id, CAST(docs.size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY docs.k NULLS FIRST, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM docs JOIN placed ON docs.k IS NOT DISTINCT FROM placed.k
"""
