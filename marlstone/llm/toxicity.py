"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are present or absent: hashed words, word pairs, and pairs with one word between. Per-coordinate
learning rates and an L1 penalty leave a sparse weight vector whose size is at most ``2 ** BITS`` entries
whatever the corpus, so it is broadcast. The classifier is fitted on a bounded sample of labelled rows
(``SAMPLE`` rows, smallest hashes of the id first) in one task; fitting and scoring take whole texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import steps, table, texts

BITS = 20
#: Labelled rows that the classifier is fitted on at most.
SAMPLE = 24_000
#: The L1 penalty is L1_RATE * sqrt(rows), L1_MOST at most: few rows give each weight little evidence.
ALPHA, BETA, L1_RATE, L1_MOST, L2, EPOCHS = 2.0, 1.0, 0.09, 5.0, 1.0, 3

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _KEEP else 0x20 for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * _M2
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Word numbers by hash; remembers frequent words, at most LIMIT of them."""

    LIMIT = 300_000

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def features(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all documents, and the document of each."""
        known = self.known
        flat: list[int] = []
        count = np.zeros(len(docs), dtype=np.int64)
        for d, text in enumerate(docs):
            words = text.translate(_TABLE).split()
            count[d] = len(words)
            try:
                flat.extend([known[w] for w in words])
            except KeyError:
                for w in set(words).difference(known):
                    known[w] = zlib.crc32(w) | zlib.adler32(w) << 32
                flat.extend([known[w] for w in words])
        if len(known) > self.LIMIT:
            known.clear()
        w = np.array(flat, dtype=np.uint64)
        doc = np.repeat(np.arange(len(docs)), count)
        keys, owners = [_mix(w * _M1)], [doc]
        for gap, salt in ((1, _M2), (2, _M3)):
            if len(w) > gap:
                same = doc[gap:] == doc[:-gap]
                keys.append(_mix(w[:-gap] * _M1 + _mix(w[gap:] * salt + np.uint64(gap)))[same])
                owners.append(doc[gap:][same])
        return (np.concatenate(keys) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owners)


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float | None = None, l2: float = L2) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over (distinct features, label); numbers and weights of what isn't zero, and the bias."""
    l1 = min(L1_MOST, L1_RATE * len(rows) ** 0.5) if l1 is None else l1
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0
    order = np.random.default_rng(7)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            x, y = rows[k]
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((beta + np.sqrt(nx)) / alpha + l2))
            bias = -bias_z / ((beta + bias_n**0.5) / alpha)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum() + bias, -35, 35))) - y
            s = (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha
            z[x] += g - s * w
            n[x] += g * g
            bias_z += g - ((bias_n + g * g) ** 0.5 - bias_n**0.5) / alpha * bias
            bias_n += g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    kept = np.flatnonzero(w)
    return kept, w[kept], -bias_z / ((beta + bias_n**0.5) / alpha)


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "label", id_col: str = "doc_id", sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from at most ``sample`` labelled rows. No labelled row, or one class only: no weights, the bias is the log odds of one half."""
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.xxhash64(F.col(id_col)).alias("h"), F.col(text_col).cast("string").alias("doc_text"), F.col(label_col).cast("int").alias("y"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for part in steps(batch, "doc_text"):
                found = texts(part, "doc_text")
                keys, doc = hasher.features(found)
                both = np.unique(doc << BITS | keys)
                cuts = np.searchsorted(both >> BITS, np.arange(len(found) + 1))
                packed = [(both[a:b] & ((1 << BITS) - 1)).astype(np.int32).tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("h"), part.column("y"), pa.array(packed, pa.binary())], names=["h", "y", "x"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((h, y, x) for b in batches for h, y, x in zip(*(b.column(c).to_pylist() for c in ("h", "y", "x")), strict=True))
        rows = [(np.frombuffer(x, dtype=np.int32), y) for _, y, x in rows]
        kept, w, bias = ftrl(rows) if len({y for _, y in rows}) == 2 else (np.zeros(0, dtype=np.int64), np.zeros(0), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([kept.astype(np.int64).tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary()), pa.array([float(bias)])], names=["k", "w", "b"])

    # the bound of the fit, not of what is scored; features first, so that no task gathers whole texts
    made = rows.mapInArrow(extract, "h long, y int, x binary").orderBy("h", "y", "x").limit(sample).repartition(1).mapInArrow(learn, "k binary, w binary, b double").first()
    if made is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0), 0.0
    return np.frombuffer(made.k, dtype=np.int64), np.frombuffer(made.w, dtype=np.float64), made.b


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out`` (0 to 1). Null and empty texts get the score of the bias alone.

    A column named as ``out`` is replaced; further columns are carried along. Nothing is shuffled.
    """
    kept, w, bias = model
    shared = docs.sparkSession.sparkContext.broadcast((kept.astype(np.int64), w, float(bias)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != out]).alias("row"), F.col(f"`{text_col}`").cast("string").alias("doc_text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, w, bias = shared.value
        dense = np.zeros(1 << BITS)
        dense[kept] = w
        hasher = Hasher()
        for whole in batches:
            for batch in steps(whole, "doc_text"):
                found = texts(batch, "doc_text")
                keys, doc = hasher.features(found)
                at = np.flatnonzero(dense[keys])
                both = np.unique(doc[at] << BITS | keys[at])
                total = np.bincount(both >> BITS, weights=dense[both & ((1 << BITS) - 1)], minlength=len(found)) + bias
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))), pa.float64())], names=["row", "score"])

    return rows.mapInArrow(score, f"row {rows.schema['row'].dataType.simpleString()}, score double").select("row.*", F.col("score").alias(out))


def held_out():
    """One row in five, by the checksum of its id, is never learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def model_of(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None):
    """The classifier from the labelled rows of ``docs`` (the table documents, where none are given)."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")).where(~held_out() & F.col("label").isNotNull())
    chosen = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)  # before the join, so that few texts are moved
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    return fit(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))  # at most SAMPLE rows of two numbers


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), model_of(spark, sf_dir))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that score below one half, with all their columns.

    Without labelled rows of both classes among ``docs`` nothing is learnt and every document stays.
    """
    kept, weights, bias = model_of(spark, sf_dir, docs)
    if not len(kept) and bias == 0.0:
        return docs
    own = "_" * (1 + max(map(len, docs.columns)))  # no column of docs
    return scored(docs, (kept, weights, bias), out=own).where(F.col(own) < 0.5).drop(own)
