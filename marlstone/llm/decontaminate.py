"""Benchmark decontamination: a broadcast set of the test items' n-grams, scanned over training token windows.

Words are ``[0-9a-z\\x80-]+`` after lower-casing A-Z. A window is 13 consecutive words of an item; an item of
1 to 12 words is one window. A document word inside any occurrence of a window is hit.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import steps, table, texts

WINDOW = 13
#: Bytes of item text in one broadcast set; items beyond it are scanned in further blocks.
BLOCK_BYTES = 8 << 20

_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


class Grams:
    """The windows of a block of items: word numbers, and for each window length the items that have it."""

    def __init__(self, items: list[tuple[object, bytes]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[object] = []
        grams: dict[int, dict[bytes, set[int]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)], dtype=np.int32)
            if len(ids):
                n, size = len(self.items), min(window, len(ids))
                self.items.append(item)
                for i in range(len(ids) - size + 1):
                    grams[size][ids[i : i + size].tobytes()].add(n)
        self.grams = {size: {k: sorted(v) for k, v in found.items()} for size, found in grams.items()}
        self.keys = {size: np.unique(self._hash(np.frombuffer(b"".join(found), dtype=np.int32).reshape(-1, size))) for size, found in self.grams.items()}

    @staticmethod
    def _hash(rows: np.ndarray) -> np.ndarray:
        key = np.zeros(len(rows), dtype=np.uint64)
        for k in range(rows.shape[1]):
            key = key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k].astype(np.uint64) + np.uint64(1)
        return key

    def scan(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, list[set[int]]]:
        """Word offsets of each document in the scanned row of ids, which of those are hit, and each document's items."""
        get = self.vocabulary.get
        flat: list[int] = []
        starts = np.zeros(len(docs) + 1, dtype=np.int64)
        for d, found in enumerate(docs):
            flat.extend([get(w, -1) for w in found])
            flat.append(-1)
            starts[d + 1] = len(flat)
        ids = np.array(flat, dtype=np.int32)
        hit = np.zeros(len(ids) + 1, dtype=np.int64)
        out: list[set[int]] = [set() for _ in docs]
        gaps = np.concatenate([[0], np.cumsum(ids < 0)])
        for size, grams in self.grams.items():
            if len(ids) < size:
                continue
            at = np.flatnonzero(gaps[size:] == gaps[:-size])
            if not len(at):
                continue
            keys = self._hash(np.lib.stride_tricks.sliding_window_view(ids, size)[at])
            known = self.keys[size]
            at = at[known[np.minimum(np.searchsorted(known, keys), len(known) - 1)] == keys]
            owner = np.searchsorted(starts, at, side="right") - 1
            for i, d in zip(at.tolist(), owner.tolist(), strict=True):
                if found := grams.get(ids[i : i + size].tobytes()):  # the hash only proposes
                    hit[i] += 1
                    hit[i + size] -= 1
                    out[d].update(found)
        return starts, np.cumsum(hit)[:-1] > 0, out


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> list[list[tuple[object, bytes]]]:
    """Items in blocks of at most BLOCK_BYTES of text (an item is never cut), so each broadcast has a bound."""
    blocks: list[list[tuple[object, bytes]]] = [[]]
    size = 0
    for item, text in benchmark.select(item_col, text_col).where(F.col(text_col).isNotNull()).toLocalIterator():
        data = text.encode()
        if size + len(data) > BLOCK_BYTES and blocks[-1]:
            blocks.append([])
            size = 0
        blocks[-1].append((item, data))
        size += len(data)
    return blocks


def _scanned(rows: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Adds n_words, hits and items to rows of (row, doc_text); one pass over the rows for each block of items, and no shuffle."""
    spark = rows.sparkSession
    out = rows.select("row", F.col("doc_text").cast("string"), F.lit(0).cast("long").alias("n_words"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("hits"), F.expr("cast(array() as array<string>)").alias("items"))
    blocks = item_blocks(benchmark, item_col, text_col)
    runs_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for block in blocks:
        shared = spark.sparkContext.broadcast(Grams(block, window))

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            grams = shared.value
            for whole in batches:
                for batch in steps(whole, "doc_text"):
                    found = [words(t) for t in texts(batch, "doc_text")]
                    starts, hit, items = grams.scan(found)
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
                    runs = batch.column("hits").to_pylist()
                    names = batch.column("items").to_pylist()
                    for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                        d = int(np.searchsorted(starts, a, side="right")) - 1
                        runs[d] = [*runs[d], {"start": a - int(starts[d]), "end": b - int(starts[d])}]
                    names = [sorted({*old, *(str(grams.items[i]) for i in x)}) for old, x in zip(names, items, strict=True)]
                    yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_text"), pa.array([len(x) for x in found], pa.int64()), pa.array(runs, runs_type), pa.array(names, pa.list_(pa.string()))], names=["row", "doc_text", "n_words", "hits", "items"])

        out = out.mapInArrow(scan, out.schema)
    return out.withColumn("hits", _merged_runs(F.col("hits"))) if len(blocks) > 1 else out


def contamination(docs: DataFrame, benchmark: DataFrame, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Hits of benchmark windows in whole texts: doc_col, n_words, hits (word runs ``start, end``), items, n_hit, n_items, contaminated.

    Null or wordless texts have no words and no hits. An empty benchmark hits nothing. Repeated rows are judged
    row by row. Only the two named columns are read, so further columns never clash.
    """
    rows = docs.select(F.struct(F.col(doc_col).alias("id")).alias("row"), F.col(text_col).alias("doc_text"))
    return judged(_scanned(rows, benchmark, item_col, item_text_col, window)).select(F.col("row.id").alias(doc_col), "n_words", "hits", "items", "n_hit", "n_items", "contaminated")


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows whose text is not contaminated, with all their columns; nothing is shuffled."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("doc_text"))
    return judged(_scanned(rows, benchmark, item_col, item_text_col, window)).where(~F.col("contaminated")).select("row.*")


def _merged_runs(runs):
    """Sorted runs with touching ones joined."""
    last = lambda acc: F.element_at(acc, -1)
    join = lambda acc, x: F.when((F.size(acc) > 0) & (last(acc)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.array_sort(runs), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"), join)


def judged(found: DataFrame) -> DataFrame:
    """Adds n_hit, n_items and contaminated (n_hit > 0 and 20 * n_hit >= n_words)."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.withColumn("n_hit", n_hit).withColumn("n_items", F.size("items").cast("long")).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are not contaminated."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[int, str | None]]) -> dict[int, tuple]:
    """The contract read literally, for small fixtures."""
    import re

    split = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = [(i, w, min(WINDOW, len(w))) for i, t in items if (w := split(t))]
    out = {}
    for d, t in docs:
        w, hit, names = split(t), set(), set()
        for i, item, size in windows:
            grams = {tuple(item[k : k + size]) for k in range(len(item) - size + 1)}
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in grams:
                    hit.update(range(k, k + size))
                    names.add(str(i))
        out[d] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
bs AS (SELECT item_id, w, least(13, len(w)) AS size FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, size, array_to_string(w[i : i + size - 1], ' ') AS gram FROM (SELECT item_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM bs)),
sizes AS (SELECT DISTINCT size FROM g),
p AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size),
h AS (SELECT p.doc_id, p.i, p.size, g.item_id FROM p JOIN g ON g.size = p.size AND g.gram = array_to_string(p.w[p.i : p.i + p.size - 1], ' ')),
hw AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM (SELECT DISTINCT doc_id, i, size FROM h)) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(hw.n_hit, 0) AS n_hit, coalesce(hi.n_items, 0) AS n_items,
  sha256(coalesce(hi.names, '')) AS items_sha256, coalesce(hw.n_hit, 0) > 0 AND 20 * coalesce(hw.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
