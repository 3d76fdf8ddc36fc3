"""Small groups handled in order, many to an Arrow batch: a group costs no call of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def map_groups(rows: DataFrame, keys: list[str], values: list[str], solve: Callable[[tuple, list[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """``solve(key, rows)`` for every group, its rows sorted by ``values``; it yields tuples of ``schema``.

    Groups must fit a task, as those of a turn or a batch do. One shuffle and one sort on the keys.
    """
    kind = to_arrow_schema(_parse_datatype_string(schema))
    width = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = (row for b in batches for row in zip(*(b.column(c).to_pylist() for c in [*keys, *values]), strict=True))
        held: list[tuple] = []
        for key, group in groupby(stream, key=lambda r: r[:width]):
            held.extend(solve(key, [r[width:] for r in group]))
            if len(held) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)

    return rows.select(*keys, *values).repartition(*keys).sortWithinPartitions(*keys, *values).mapInArrow(run, schema)
