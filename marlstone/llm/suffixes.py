"""Exact substring deduplication by bucket-pointer refinement.

Every byte position has bucket identifiers of growing length, each made of two identifiers of half the length
at offsets already known (1, 2, 4, 8, 16, 32 bytes, then 24 and 50 by overlap), so updates are reused
recursively as in the refinement of a suffix array. Only anchors are bucketed: in each string of 50 bytes the
position whose 24-byte bucket has the smallest identifier. Equal strings have equal anchors, so buckets of
anchors hold every repeat, with a thirteenth of all positions.

Level 1 sorts anchors by (bucket of 24 bytes, identifiers of the first and last string of the anchor's
stretch): stretches equal to one of a smaller document go whole. Level 2 refines only buckets that still mix
different stretches of several documents, by the 50-byte identifiers at all their offsets. Before either
shuffle each task keeps the smallest document of a key and removes the others' bytes at once, so a passage
shared by any number of documents costs one row a batch of texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, steps, table, texts

LENGTH, GRAM = 50, 24
#: Text bytes whose keys are pre-aggregated together in a task; strings in one segment of a very long text.
GATHER, SEGMENT = 8 << 20, 1 << 20
_PLACE = np.uint64((1 << 24) - 1)
_BYTES = np.random.default_rng(50).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _join(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    z = x * np.uint64(0x9E3779B97F4A7C15)
    z += y * np.uint64(0xC2B2AE3D27D4EB4F)
    z ^= z >> np.uint64(29)
    z *= np.uint64(0x165667B19E3779F9)
    z ^= z >> np.uint64(32)
    return z


def identifiers(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of the 24 and of the 50 bytes from each position on."""
    size, x = 1, _BYTES[data]
    while size < 16:
        x, size = _join(x[:-size], x[size:]), 2 * size
    gram = _join(x[: -(GRAM - 16)], x[GRAM - 16 :])
    x = _join(x[:-16], x[16:])
    return gram, _join(x[: -(LENGTH - 32)], x[LENGTH - 32 :])


def stretches(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of strings with one anchor: bucket, identifier, first string, last string. ``ends``: each byte's text end."""
    n = len(data) - LENGTH + 1
    if n <= 0:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64))
    gram, whole = identifiers(data)
    width = LENGTH - GRAM + 1
    anchor = np.zeros(n, dtype=np.int64)
    for s in range(0, n, SEGMENT):
        e = min(n, s + SEGMENT)
        m = (gram[s : e + width - 1] & ~_PLACE) | np.arange(e - s + width - 1, dtype=np.uint64)  # ties: the leftmost
        w = 1
        while 2 * w <= width:
            m = np.minimum(m[:-w], m[w:])
            w *= 2
        if w < width:
            m = np.minimum(m[: len(m) - (width - w)], m[width - w :])
        anchor[s:e] = (m & _PLACE).astype(np.int64) + s
    inside = np.arange(LENGTH, n + LENGTH) <= ends[:n]
    cut = np.ones(n, dtype=bool)
    cut[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(cut)
    last = np.append(first[1:], n) - 1
    first, last = first[inside[first]], last[inside[first]]
    name = _join(_join(whole[first], whole[last]), (last - first).astype(np.uint64))
    return gram[anchor[first]], name, first, last


def _laid(found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts one after the other, where each starts, and the end of each byte's text."""
    size = np.array([len(t) for t in found], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(size)])
    return np.frombuffer(b"".join(found), dtype=np.uint8), starts, np.repeat(starts[1:], size)


def _smallest(x: np.ndarray, y: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which rows have the smallest document of their key (x, y)."""
    order = np.lexsort((doc, y, x))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (x[order][1:] != x[order][:-1]) | (y[order][1:] != y[order][:-1])
    least = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    out = np.zeros(len(order), dtype=bool)
    out[order] = doc[order] == least
    return out


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of each document with touching ones joined; those of one document have ascending ends."""
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], end[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > end[:-1])
    at = np.flatnonzero(new)
    return (doc[at], start[at], np.maximum.reduceat(end, at)) if len(at) else (doc, start, end)


_KEYS = "x long, y long, doc long, place long"


def _keyed(x: np.ndarray, y: np.ndarray, doc: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """Rows for the shuffle: keys of smallest documents (place: first * 256 + last - first), and what is removed already (y: start, place: -end)."""
    keep = _smallest(x, y, doc)
    gone = ~keep
    d, s, e = _merged(doc[gone], first[gone], last[gone] + LENGTH)
    columns = [
        np.concatenate([x[keep].view(np.int64), d * 7919 + s]), np.concatenate([y[keep].view(np.int64), s]),
        np.concatenate([doc[keep], d]), np.concatenate([first[keep] << 8 | last[keep] - first[keep], -e]),
    ]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["x", "y", "doc", "place"])


def _gathered(parts: Iterator[tuple[np.ndarray, ...]], sizes: list[int]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    for part in parts:
        held.append(part)
        if sizes[0] >= GATHER:
            yield _keyed(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held, sizes[0] = [], 0
    if held:
        yield _keyed(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sizes = [0]

    def parts() -> Iterator[tuple[np.ndarray, ...]]:
        for whole in batches:
            for batch in steps(whole, "doc_text"):
                data, starts, ends = _laid(texts(batch, "doc_text"))
                gram, name, first, last = stretches(data, ends)
                owner = np.searchsorted(starts, first, side="right") - 1
                sizes[0] += len(data)
                yield gram, name, np.asarray(batch.column("doc"), dtype=np.int64)[owner], first - starts[owner], last - starts[owner]

    return _gathered(parts(), sizes)


_FOUND = "doc long, start long, end long, bucket long, again boolean"


def _found(doc, start, end, bucket, again: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in (doc, start, end, bucket)), pa.array(np.full(len(doc), again))], names=["doc", "start", "end", "bucket", "again"])


def _columns(batch: pa.RecordBatch) -> tuple[list[np.ndarray], pa.RecordBatch]:
    """Key columns, and what was removed before the shuffle."""
    x, y, doc, place = (np.asarray(batch.column(c)) for c in ("x", "y", "doc", "place"))
    done, key = place < 0, place >= 0
    return [c[key] for c in (x, y, doc, place)], _found(doc[done], y[done], -place[done], np.zeros(done.sum(), dtype=np.int64), False)


def _refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Level 1 over keys sorted by (x, y, doc): removed stretches, and the stretches that level 2 must look into (again)."""
    last: dict | None = None  # of the bucket that the last batch ended in
    for batch in batches:
        (x, y, doc, place), before = _columns(batch)
        yield before
        if not len(x):
            continue
        new_x, new_y = np.ones(len(x), dtype=bool), np.ones(len(x), dtype=bool)
        new_x[1:] = x[1:] != x[:-1]
        new_x[0] = last is None or x[0] != last["x"]
        new_y[1:] = new_x[1:] | (y[1:] != y[:-1])
        new_y[0] = new_x[0] or y[0] != last["y"]
        at_y = np.flatnonzero(new_y | (np.arange(len(x)) == 0))
        least = doc[at_y].copy()
        if not new_y[0]:
            least[0] = last["least"]
        of_row = np.repeat(least, np.diff(np.append(at_y, len(x))))
        gone = doc > of_row
        at_x = np.flatnonzero(new_x | (np.arange(len(x)) == 0))
        low, high, kinds = np.minimum.reduceat(doc, at_x), np.maximum.reduceat(doc, at_x), np.add.reduceat(new_y.astype(np.int64), at_x)
        if not new_x[0]:
            low[0], high[0], kinds[0] = min(low[0], last["low"]), max(high[0], last["high"]), kinds[0] + last["kinds"]
        mixed = (low != high) & (kinds > 1)
        again = ~gone & np.repeat(mixed, np.diff(np.append(at_x, len(x))))
        start, end = place >> 8, (place >> 8) + (place & 255)
        yield _found(doc[gone], start[gone], end[gone] + LENGTH, x[gone], False)
        yield _found(doc[again], start[again], end[again], x[again], True)
        waiting = [np.zeros(0, dtype=np.int64)] * 3
        if not new_x[0]:
            if mixed[0]:
                yield _found(*last["waiting"], np.full(len(last["waiting"][0]), x[0]), True)
            elif len(at_x) == 1:
                waiting = last["waiting"]
        tail = np.arange(len(x)) >= at_x[-1]
        tail &= ~gone & ~mixed[-1]  # of one document only, else they would be mixed or gone
        waiting = [np.concatenate([a, b[tail]]) for a, b in zip(waiting, (doc, start, end), strict=True)]
        last = {"x": x[-1], "y": y[-1], "least": least[-1], "low": low[-1], "high": high[-1], "kinds": kinds[-1], "waiting": waiting}


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keys of level 2: the 50-byte identifiers of all strings of the stretches in question."""
    sizes = [0]

    def parts() -> Iterator[tuple[np.ndarray, ...]]:
        for whole in batches:
            for batch in steps(whole, "doc_text"):
                data, starts, _ = _laid(texts(batch, "doc_text"))
                if len(data) < LENGTH:
                    continue
                ids = identifiers(data)[1]
                asked = batch.column("asked")
                per = np.diff(np.asarray(asked.offsets))
                flat = asked.flatten()
                owner = np.repeat(np.arange(len(per)), per)
                start, end, bucket = (np.asarray(flat.field(k)) for k in range(3))
                count = end - start + 1
                row = np.repeat(np.arange(len(start)), count)
                place = start[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                sizes[0] += len(row) * 8
                yield ids[starts[owner[row]] + place], bucket[row].view(np.uint64), np.asarray(batch.column("doc"), dtype=np.int64)[owner[row]], place, place

    return _gathered(parts(), sizes)


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Level 2 over keys sorted by (x, y, doc): the strings that a smaller document has too."""
    last: tuple | None = None
    for batch in batches:
        (x, y, doc, place), before = _columns(batch)
        yield before
        if not len(x):
            continue
        new = np.ones(len(x), dtype=bool)
        new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        least = doc.copy()
        if last is not None and (x[0], y[0]) == last[:2]:
            least[0] = last[2]
        of_row = least[np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))]
        gone = doc > of_row
        d, s, e = _merged(doc[gone], place[gone] >> 8, (place[gone] >> 8) + LENGTH)
        yield _found(d, s, e, np.zeros(len(d), dtype=np.int64), False)
        last = (x[-1], y[-1], of_row[-1])


def _remaining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each text, with the figures of what went."""
    for whole in batches:
        for batch in steps(whole, "doc_text"):
            found = texts(batch, "doc_text")
            data, starts, _ = _laid(found)
            gone = batch.column("gone")
            per = np.diff(np.asarray(gone.offsets))
            flat = gone.flatten()
            base = np.repeat(starts[:-1], per)
            step = np.zeros(len(data) + 1, dtype=np.int64)
            np.add.at(step, np.asarray(flat.field(0)) + base, 1)
            np.add.at(step, np.asarray(flat.field(1)) + base, -1)
            mask = np.cumsum(step)[:-1] > 0
            total = np.concatenate([[0], np.cumsum(mask)])
            edge = mask.copy()
            edge[1:] &= ~mask[:-1]
            first = starts[:-1][starts[:-1] < starts[1:]]
            edge[first] = mask[first]
            runs = np.concatenate([[0], np.cumsum(edge)])
            removed = total[starts[1:]] - total[starts[:-1]]
            kept = [t if not r else data[a:b][~mask[a:b]].tobytes() for t, r, a, b in zip(found, removed.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(np.diff(starts)), pa.array(removed), pa.array(runs[starts[1:]] - runs[starts[:-1]]), pa.array([hashlib.sha256(k).hexdigest() for k in kept]), pa.array(kept, pa.binary())],
                names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content: bool = True) -> DataFrame:
    """All columns of ``docs``, n_bytes, n_removed, n_spans, kept_sha256 and, with ``content``, ``kept`` (bytes).

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller id; strings are judged
    on the input and never cross documents. Null and empty texts have no bytes. Ids are integers and unique but for
    repeated rows, which are judged alike and never remove each other's bytes; rows without an id keep all bytes
    and remove none. Columns of ``docs`` with the names of results are replaced.
    """
    spark = docs.sparkSession
    results = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    scratch = Scratch(spark, "substrings")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("doc_text"))
    long = rows.where(f"doc IS NOT NULL AND octet_length(doc_text) >= {LENGTH}")
    first = scratch.cut(long.mapInArrow(_anchors, _KEYS).repartition("x").sortWithinPartitions("x", "y", "doc").mapInArrow(_refine, _FOUND))
    scratch.release()
    asked = first.where("again").groupBy("doc").agg(F.collect_list(F.struct("start", "end", "bucket")).alias("asked"))  # of one text: bounded by its length
    keys = long.join(asked.hint("merge"), "doc").select("doc", "doc_text", "asked").mapInArrow(_windows, _KEYS)
    second = scratch.cut(keys.repartition("x").sortWithinPartitions("x", "y", "doc").mapInArrow(_repeats, _FOUND))
    scratch.release()
    gone = first.where("NOT again").select("doc", "start", "end").unionByName(second.select("doc", "start", "end")).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in results]).alias("row"), F.col(f"`{id_col}`").cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("doc_text"))
    joined = whole.join(gone.hint("merge"), "doc", "left").select("row", "doc_text", F.coalesce("gone", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")).alias("gone"))
    out = joined.mapInArrow(_remaining, f"row {whole.schema['row'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select("row.*", *(results if content else results[:-1]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute_force(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int, str]]:
    """The contract read literally, for small fixtures."""
    data = {d: (t or "").encode() for d, t in docs}
    least: dict[bytes, int] = {}
    for d in sorted(data):
        for k in range(len(data[d]) - LENGTH + 1):
            least.setdefault(data[d][k : k + LENGTH], d)
    out = {}
    for d, t in data.items():
        mask = bytearray(len(t))
        for k in range(len(t) - LENGTH + 1):
            if least[t[k : k + LENGTH]] < d:
                mask[k : k + LENGTH] = b"\1" * LENGTH
        spans = sum(m and (k == 0 or not mask[k - 1]) for k, m in enumerate(mask))
        out[d] = (len(t), sum(mask), spans, hashlib.sha256(bytes(b for b, m in zip(t, mask, strict=True) if not m)).hexdigest())
    return out
