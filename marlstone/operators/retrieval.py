"""Dense retrieval: the nearest stored vectors of a set of query vectors by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import unit
from .rows import held

#: Query vectors in one broadcast block; each block is a pass over the stored vectors.
QUERY_BLOCK = 8192
#: Queries and stored vectors whose products a task holds at once.
TILE_QUERIES, TILE_STORED = 256, 1024


def _keep(best: tuple[np.ndarray, np.ndarray], at: slice, ids: np.ndarray, q: np.ndarray, own: np.ndarray, x: np.ndarray) -> None:
    """Takes the tile's nearest into the best of the queries ``at``; rows that none of them would take are not sorted."""
    near = np.round(q[at] @ x.T, 9)
    near[ids[at, None] == own[None, :]] = -np.inf
    rows = np.flatnonzero((near >= best[1][at][:, -1:]).any(1) & np.isfinite(near).any(1))
    if not len(rows):
        return
    found_id, found = np.hstack([best[0][at][rows], np.broadcast_to(own, (len(rows), len(own)))]), np.hstack([best[1][at][rows], near[rows]])
    order = np.lexsort((found_id, -found), axis=1)[:, : best[0].shape[1]]
    best[0][at.start + rows], best[1][at.start + rows] = np.take_along_axis(found_id, order, 1), np.take_along_axis(found, order, 1)


def _search(rows: DataFrame, shared, k: int) -> DataFrame:
    """Of each task the k nearest of its rows for each query of the block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {w: (np.full((len(ids), k), np.iinfo(np.int64).max), np.full((len(ids), k), -np.inf)) for w, (ids, _) in shared.value.items()}
        for b in batches:
            width = np.diff(np.asarray(b.column("v").offsets))
            for w, (ids, q) in shared.value.items():
                part = b.filter(pa.array(width == w))
                if not part.num_rows:
                    continue
                x, own = np.asarray(part.column("v").flatten()).reshape(-1, w), np.asarray(part.column("id"))
                for a in range(0, len(ids), TILE_QUERIES):
                    for s in range(0, len(x), TILE_STORED):
                        _keep(best[w], slice(a, a + TILE_QUERIES), ids, q, own[s : s + TILE_STORED], x[s : s + TILE_STORED])
        for w, (ids, _) in shared.value.items():
            ok = np.isfinite(best[w][1])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, ok.sum(1))), pa.array(best[w][0][ok]), pa.array(best[w][1][ok])], names=["query_id", "id", "similarity"])

    found = rows.mapInArrow(search, "query_id long, id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(stored: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int = 10) -> DataFrame:
    """query_id, id, similarity, rank: the k nearest other rows of each query; ties (to 9 digits) go to the smaller id.

    Zero vectors take no part; vectors meet those of their own length. Each task keeps k rows a query, so what is
    shuffled grows with queries and tasks and not with pairs. Queries go block by block: one block is on the driver
    and broadcast at a time, its result is written, and its broadcast ends before the next one begins.
    """
    spark = stored.sparkSession
    rows = stored.select(F.col(id_col).cast("long").alias("id"), unit(F.col(vector_col)).alias("v")).where("v IS NOT NULL AND id IS NOT NULL")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), unit(F.col(vector_col)).alias("v")).where("v IS NOT NULL AND id IS NOT NULL").toLocalIterator()
    parts: list[DataFrame] = []
    while block := list(islice(asked, QUERY_BLOCK)):
        by_width: dict[int, list] = {}
        for r in block:
            by_width.setdefault(len(r.v), []).append(r)
        shared = spark.sparkContext.broadcast({w: (np.array([r.id for r in of_width]), np.array([r.v for r in of_width])) for w, of_width in by_width.items()})
        found = _search(rows, shared, k)
        if not parts and len(block) < QUERY_BLOCK:
            return found  # the only block
        parts.append(held(found))
        shared.destroy()
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "query_id long, id long, similarity double, rank int")
