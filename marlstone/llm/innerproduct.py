"""Exact top-k search by inner product over norm-sorted vectors.

Vectors are dealt by descending length. Queries go in bounded blocks; for each block every task walks its
vectors from the longest on and stops for a query once length times query length falls below the query's
threshold (Cauchy-Schwarz). What is left is pruned by partial sums over the first coordinates of an SVD
rotation plus the bound on the rest, and only survivors get their exact product. Thresholds start from the
scores of a bounded number of longest vectors, so every task prunes from the beginning.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, table

#: Queries in one broadcast block, longest vectors that set the first thresholds, vectors in one step, leading coordinates.
QUERY_BLOCK, SEEDS, STEP, HEAD = 8192, 1024, 2048, 24


def vectors(source: DataFrame, id_col: str, vector_col: str, scale: float | None) -> DataFrame:
    """vec_id, v: finite vectors (floored multiples of scale, where one is given) and their squared length.

    Null vectors, empty ones, and vectors with null, NaN or infinite components take no part.
    """
    c = F.col(f"`{vector_col}`")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = source.where(F.col(f"`{id_col}`").isNotNull() & c.isNotNull() & (F.size(c) > 0) & F.forall(c, finite))
    scaled = F.transform(c, lambda x: F.floor(x.cast("double") * scale).cast("double")) if scale else c.cast("array<double>")
    out = ok.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), scaled.alias("v"))
    return out.withColumn("n2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of vectors; missing trailing components count as zero."""
    width = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten(), dtype=np.float64)
    if (width == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(column), dim))
    out[np.repeat(np.arange(len(column)), width), np.concatenate([np.arange(w) for w in width])] = flat
    return out


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """The SVD rotation of all vectors, from their summed outer products (dim x dim, whatever the number of rows)."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            x = _matrix(b.column("v"), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "r"])

    parts = rows.select("v").mapInArrow(outer, "i int, r array<double>").select("i", F.posexplode("r").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x"))
    gram = np.zeros((dim, dim))
    for i, j, x in parts.collect():  # dim * dim rows
        gram[i, j] = x
    return np.linalg.svd(gram)[0]


def _topk(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best (score, then smaller id)."""
    order = np.lexsort((ids, -score, q))
    first = np.concatenate([[True], q[order][1:] != q[order][:-1]]) if len(order) else np.zeros(0, dtype=bool)
    start = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0)) if len(order) else np.zeros(0, dtype=int)
    return order[np.arange(len(order)) - start < k]


class Block:
    """A block of queries with rotated coordinates and thresholds."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, turn: np.ndarray, seed_ids: np.ndarray, seeds: np.ndarray, k: int, whole: bool):
        self.ids, self.q, self.k, self.whole = ids, q, k, whole
        head = min(HEAD, q.shape[1])
        self.turn = turn
        self.head = (q @ turn)[:, :head]
        self.length = np.sqrt((q * q).sum(1))
        self.rest = np.sqrt(np.maximum(self.length**2 - (self.head**2).sum(1), 0))
        self.least = np.full(len(ids), -np.inf)
        if len(seeds) > k:
            s = q @ seeds.T
            s[ids[:, None] == seed_ids[None, :]] = -np.inf
            self.least = np.partition(s, -k, axis=1)[:, -k]

    def search(self, chunks: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query place, vec_id, score) of what may be among the k best, from chunks by descending length."""
        least, k = self.least.copy(), self.k
        slack = 0.5 if self.whole else 0.0
        got = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0))
        for ids, x in chunks:
            length = np.sqrt((x * x).sum(1))
            eps = slack + 1e-9 * length.max(initial=0) * self.length
            alive = np.flatnonzero(self.length * length.max(initial=0) >= least - eps)
            if not len(alive):
                continue
            head = (x @ self.turn)[:, : self.head.shape[1]]
            rest = np.sqrt(np.maximum(length**2 - (head**2).sum(1), 0))
            for a in range(0, len(alive), 1024):
                part = alive[a : a + 1024]
                bound = self.head[part] @ head.T
                bound += self.rest[part][:, None] * rest[None, :]
                qi, xi = np.nonzero(bound >= (least - eps)[part][:, None])
                if not len(qi):
                    continue
                if len(qi) * 4 > len(part) * len(x):
                    score = (self.q[part] @ x.T)[qi, xi]
                else:
                    score = np.concatenate([np.einsum("ij,ij->i", self.q[part[qi[s : s + 65536]]], x[xi[s : s + 65536]]) for s in range(0, len(qi), 65536)])
                ok = (score >= least[part[qi]]) & (self.ids[part[qi]] != ids[xi])
                got = tuple(np.concatenate([o, n]) for o, n in zip(got, (part[qi[ok]], ids[xi[ok]], score[ok]), strict=True))
            kept = _topk(*got, k)
            got = tuple(o[kept] for o in got)
            if len(kept):
                q, count = np.unique(got[0], return_counts=True)
                worst = np.full(len(self.ids), np.inf)
                np.minimum.at(worst, got[0], got[2])
                full = q[count == k]
                least[full] = np.maximum(least[full], worst[full])
        return got


def top_k(source: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: float | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every query row with all other rows.

    Ties go to the smaller vec_id. Rows without a usable vector take no part (see :func:`vectors`); vectors of
    unequal length are compared as if the shorter ended in zeros. A query with fewer than k other rows gets all of
    them; repeated ids count as one row's own and are never each other's result. With ``scale`` components are
    floored multiples and scores are exact integers.
    """
    spark = source.sparkSession
    kind = "long" if scale else "double"
    scratch = Scratch(spark, "top-k")
    rows = scratch.cut(vectors(source, id_col, vector_col, scale).repartitionByRange(F.desc("n2"), F.asc("vec_id")).sortWithinPartitions(F.desc("n2"), "vec_id"))
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    result = f"query_id long, vec_id long, score {kind}"
    if dim is None:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {kind}")
    turn = rotation(rows, dim)
    seeds = rows.orderBy(F.desc("n2"), "vec_id").limit(SEEDS).select("vec_id", "v").toArrow()
    seed_ids, seed_rows = np.asarray(seeds.column("vec_id")), _matrix(seeds.column("v").combine_chunks(), dim)
    # queries are numbered over partition counts and kept as blocks; one block at a time is broadcast and its own best are written
    asked = scratch.cut(rows.where(is_query(F.col("vec_id"))).select("vec_id", "v", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("pos")))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = asked.groupBy("part").agg(F.max(F.col("pos") + 1).alias("n")).select("part", before.alias("start"))  # a row for each partition
    asked = scratch.cut(asked.join(F.broadcast(starts), "part").select("vec_id", "v", F.floor((F.col("start") + F.col("pos")) / QUERY_BLOCK).alias("block")))
    last = asked.agg(F.max("block")).first()[0]
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = None
    for number in range(0 if last is None else last + 1):
        block = asked.where(F.col("block") == number).select("vec_id", "v").toArrow()  # QUERY_BLOCK rows at most
        if not block.num_rows:
            continue
        q = _matrix(block.column("v").combine_chunks(), dim)
        shared = spark.sparkContext.broadcast(Block(np.asarray(block.column("vec_id")), q, turn, seed_ids, seed_rows, k, bool(scale)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = shared.value
            chunks = ((np.asarray(p.column("vec_id")), _matrix(p.column("v"), dim)) for b in batches for p in (b.slice(s, STEP) for s in range(0, b.num_rows, STEP)))
            q, ids, score = block.search(chunks)
            yield pa.RecordBatch.from_arrays([pa.array(block.ids[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(score.astype(np.int64) if block.whole else score)], names=["query_id", "vec_id", "score"])

        each = rows.select("vec_id", "v").mapInArrow(search, result)
        each = scratch.cut(each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        shared.destroy()
        found = each if found is None else found.unionByName(each)
    if found is None:
        return spark.createDataFrame([], f"query_id long, rank int, vec_id long, score {kind}")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)  # k rows a query; repeated ids may be in two blocks
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda c: c % 20 == 0, 20, scale=64.0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
