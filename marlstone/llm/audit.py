"""Filter interaction audit on a packed bitmap index.

Each task packs the failures of its documents into bitsets by filter, label and part. For every set of filters
that may come first, AND-NOT of their bitsets leaves the documents that passed them all; a population count
gives their number, in all and by label. The counts of all tasks are summed, and what each filter removes at
each place of each order is a difference of two of them.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, steps, table, texts

FILTERS = "ABCDE"
#: Documents of a part whose bits a task packs together, and parts that it holds at a time.
ROWS, PARTS = 1 << 16, 1 << 12
#: Most filters: their orders are listed.
MOST = 7
UPPER = bytes(range(ord("A"), ord("Z") + 1))
CONTINUED = bytes(range(0x80, 0xC0))
SIGNS = re.compile(rb"[#$%&*|]")


def failures(docs: DataFrame, doc: str = "doc_id", part: str = "lang", text_col: str = "text") -> DataFrame:
    """doc, part, key (SHA-256 of the text) and A, B, C, D: whether the document fails.

    A: under 200 words; B: fewer than half of the words distinct; C: more than 3 of 100 characters in A-Z; D: holds
    one of #$%&*|. Null and empty texts have no word and fail A alone. A null part is the empty string.
    """
    rows = docs.select(F.col(f"`{doc}`").alias("doc"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text_col}`").cast("string").alias("doc_text"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in steps(whole, "doc_text"):
                made = []
                for t in texts(batch, "doc_text"):
                    words = t.split()  # of bytes: at the space and 0x09 to 0x0D
                    upper, points = len(t) - len(t.translate(None, UPPER)), len(t.translate(None, CONTINUED))
                    made.append((hashlib.sha256(t).digest(), len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * upper > 3 * points, SIGNS.search(t) is not None))
                cols = list(zip(*made, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("part"), pa.array(cols[0], pa.binary()), *[pa.array(c, pa.bool_()) for c in cols[1:]]], names=["doc", "part", "key", *FILTERS[:4]])

    return rows.mapInArrow(judge, f"doc {rows.schema['doc'].dataType.simpleString()}, part string, key binary, A boolean, B boolean, C boolean, D boolean")


def bitmap_index(rows: DataFrame, columns: list[str], part: str = "part") -> DataFrame:
    """part, n and a packed bitset (binary) for each boolean column, of at most ROWS rows of a part each. Null counts as false."""
    rows = rows.select(F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), *[F.coalesce(F.col(f"`{c}`").cast("boolean"), F.lit(False)).alias(c) for c in columns])

    def packed(held: dict[str, list[np.ndarray]]) -> pa.RecordBatch:
        bits = [np.concatenate(x, axis=1) for x in held.values()]
        return pa.RecordBatch.from_arrays([pa.array(held, pa.string()), pa.array([b.shape[1] for b in bits], pa.int64()), *[pa.array([np.packbits(b[k]).tobytes() for b in bits], pa.binary()) for k in range(len(columns))]], names=["part", "n", *columns])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = {}, 0
        for batch in batches:
            bits = np.array([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], bool).reshape(len(columns), len(batch))
            names = batch.column("part").dictionary_encode()
            codes = names.indices.to_numpy()
            for k, name in enumerate(names.dictionary.to_pylist()):
                held.setdefault(name, []).append(bits[:, codes == k])
            n += len(batch)
            if n >= ROWS or len(held) >= PARTS:
                yield packed(held)
                held, n = {}, 0
        if held:
            yield packed(held)

    return rows.mapInArrow(pack, "part string, n long, " + ", ".join(f"`{c}` binary" for c in columns))


def survivor_counts(index: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """part, chosen (bits of a set of filters), n and a count for each label: documents that fail none of the chosen filters."""
    sets = 1 << len(filters)

    def counted(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        counts = np.concatenate(list(held.values()))
        return pa.RecordBatch.from_arrays([pa.array([p for p in held for _ in range(sets)], pa.string()), pa.array(list(range(sets)) * len(held), pa.int32()), *[pa.array(counts[:, k], pa.int64()) for k in range(1 + len(labels))]], names=["part", "chosen", "n", *labels])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                fails = [np.frombuffer(row[f], np.uint8) for f in filters]
                masks = [np.frombuffer(row[x], np.uint8) for x in labels]
                found, alive = held.setdefault(row["part"], np.zeros((sets, 1 + len(labels)), np.int64)), [np.packbits(np.ones(row["n"], bool))]
                for chosen in range(sets):
                    if chosen:
                        last = chosen.bit_length() - 1
                        alive.append(alive[chosen ^ 1 << last] & ~fails[last])
                    found[chosen] += [int(np.bitwise_count(x).sum()) for x in (alive[chosen], *[alive[chosen] & m for m in masks])]
            if len(held) >= PARTS:
                yield counted(held)
                held = {}
        if held:
            yield counted(held)

    schema = "part string, chosen int, n long, " + ", ".join(f"`{x}` long" for x in labels)
    return index.mapInArrow(count, schema).groupBy("part", "chosen").agg(*[F.sum(F.col(f"`{x}`")).alias(x) for x in ("n", *labels)])


def orders(spark: SparkSession, filters: list[str]) -> DataFrame:
    """order (the filters' names joined), step (from 1), own (the filter's bit), before (bits of those before it): a row for each step of each order."""
    if len(filters) > MOST:
        raise ValueError(f"{len(filters)} filters have more orders than are listed; at most {MOST}")
    made = [("".join(filters[k] for k in order), step + 1, 1 << order[step], sum(1 << k for k in order[:step])) for order in itertools.permutations(range(len(filters))) for step in range(len(filters))]
    return spark.createDataFrame(made, "filter_order string, step int, own int, before int")


def interactions(counts: DataFrame, filters: list[str], labels: dict[str, str]) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, shapley, and a count of removed documents for each label (result name: label).

    All counts are of the part's documents, zeros included: kept after the step, removed by it, redundant (failing
    its filter but removed before), unique_fails (failing no other filter), shapley (removed by the step's filter,
    summed over all orders).
    """
    every = (1 << len(filters)) - 1
    other = lambda name: counts.select(F.col("part").alias(f"{name}_part"), F.col("chosen").alias(f"{name}_chosen"), *[F.col(f"`{c}`").alias(f"{name}_{c}") for c in ("n", *labels.values())])
    # what each filter removes after each set: a row for each part, filter and set without it
    own = F.explode(F.array(*[F.lit(1 << k) for k in range(len(filters))])).alias("own")
    gone = counts.select("*", own).where("chosen & own = 0").join(other("after"), (F.col("part") == F.col("after_part")) & (F.col("chosen").bitwiseOR(F.col("own")) == F.col("after_chosen")))
    gone = gone.select("part", "own", F.col("chosen").alias("before"), F.col("after_n").alias("kept"), (F.col("n") - F.col("after_n")).alias("removed"), *[(F.col(f"`{c}`") - F.col(f"`after_{c}`")).alias(out) for out, c in labels.items()])
    sizes = F.bit_count("before")
    weight = F.element_at(F.array(*[F.lit(math.factorial(k) * math.factorial(len(filters) - 1 - k)) for k in range(len(filters))]), sizes + 1)
    of_filter = gone.groupBy("part", "own").agg(
        F.sum(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.sum(F.when(F.col("before").bitwiseOR(F.col("own")) == every, F.col("removed"))).alias("unique_fails"),
        F.sum(F.col("removed") * weight).alias("shapley"),
    )
    listed = F.broadcast(orders(counts.sparkSession, filters))
    return gone.join(of_filter, ["part", "own"]).join(listed, ["own", "before"]).select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *labels, "shapley")


def judged(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", part: str = "lang", text_col: str = "text") -> DataFrame:
    """doc, part, A to E, good, toxic of every document; E: an equal text has a smaller id.

    Rows are counted as they are: repeated rows are documents each and fail E only if a smaller id has their text. A
    null id is neither smaller than another one nor larger, and has no label. A document is good or toxic if any row
    of ``labels`` says so. Whole texts of any length are judged; an empty table gives an empty one; extra columns of
    either table are not read.
    """
    scratch = Scratch(docs.sparkSession, "audit")
    rows = scratch.cut(failures(docs, doc, part, text_col))
    copies = scratch.cut(rows.groupBy(F.col("key").alias("k")).agg(F.min("doc").alias("first"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    marks = scratch.cut(labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("q"), F.max((F.col("toxic") == 1).cast("int")).alias("x")))
    found = rows.join(copies, F.col("key") == F.col("k"), "left").withColumn("E", F.coalesce(F.col("doc") > F.col("first"), F.lit(False))).drop("key", "k", "first")
    return found.join(marks, F.col("doc") == F.col("labelled"), "left").select("doc", "part", *FILTERS, (F.coalesce("q", F.lit(0)) == 1).alias("good"), (F.coalesce("x", F.lit(0)) == 1).alias("toxic"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    index = bitmap_index(rows, [*FILTERS, "good", "toxic"])
    counts = Scratch(spark, "audit").cut(survivor_counts(index, [*FILTERS], ["good", "toxic"]))
    return interactions(counts, [*FILTERS], {"good_lost": "good", "toxic_lost": "toxic"})


SQL = r"""
WITH marks AS (SELECT doc_id, max(CAST(coalesce(quality, 0) = 1 AS INTEGER)) AS q, max(CAST(coalesce(toxic, 0) = 1 AS INTEGER)) AS x FROM labels GROUP BY doc_id),
docs AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
judged AS (SELECT part, coalesce(q, 0) AS q, coalesce(x, 0) AS x, CAST(len(w) < 200 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INTEGER)
    + 4 * CAST(100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) AS INTEGER) + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER)
    + 16 * CAST(coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS INTEGER) AS f
  FROM docs LEFT JOIN marks USING (doc_id)),
tallies AS (SELECT part, f, count(*) AS n, sum(q) AS q, sum(x) AS x FROM judged GROUP BY part, f),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
orders AS (SELECT [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits, a.c || b.c || c.c || d.c || e.c AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
placed AS (SELECT filter_order, CAST(s AS INTEGER) AS step, bits[s] AS own, CAST(coalesce(list_sum(bits[1:s - 1]), 0) AS INTEGER) AS before FROM orders, range(1, 6) r(s)),
steps AS (SELECT part, filter_order, step, own, CAST(sum(CASE WHEN f & (own | before) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
    CAST(sum(CASE WHEN f & own <> 0 AND f & before = 0 THEN n ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN f & own <> 0 AND f & before <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
    CAST(sum(CASE WHEN f = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails, CAST(sum(CASE WHEN f & own <> 0 AND f & before = 0 THEN q ELSE 0 END) AS BIGINT) AS good_lost,
    CAST(sum(CASE WHEN f & own <> 0 AND f & before = 0 THEN x ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM tallies, placed GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM steps
"""
