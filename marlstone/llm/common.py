"""Helpers that the training-data operators share."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text bytes that one vectorised step inside a task works on; bounds a task's memory.
STEP_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="marlstone-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; a table can be dropped once nothing reads it any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def cut(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def release(self) -> None:
        """Lets Spark clean up the shuffle files of finished steps now; it does so when unused plans are collected.

        The first round ends the driver's handles of plans, the second what the plans held.
        """
        for _ in range(2):
            gc.collect()
            self.spark._jvm.System.gc()
            time.sleep(0.5)

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "scratch_path", None)
        if path:
            jvm = self.spark._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(batch: pa.RecordBatch, column: str, limit: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each (one row at least; a row is never cut)."""
    data = batch.column(column)
    if not len(data):
        return
    width = np.frombuffer(data.buffers()[1], dtype=np.int64 if pa.types.is_large_string(data.type) or pa.types.is_large_binary(data.type) else np.int32, count=len(data) + 1 + data.offset)[data.offset :]
    start = 0
    while start < len(data):
        end = max(start + 1, int(np.searchsorted(width, width[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A text column as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
