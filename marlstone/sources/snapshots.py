"""Versioned snapshots of a state, upgrades between schema versions, and where a loader goes on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Upgrade = Callable[[DataFrame], DataFrame]


def save(state: DataFrame, folder: str, number: int, version: int) -> None:
    """The state as snapshot ``number`` of a schema version; a snapshot is whole or not there (Parquet's commit), and never changed."""
    state.write.mode("errorifexists").parquet(f"{folder}/snapshot={number}/version={version}")


def snapshots(spark: SparkSession, folder: str) -> list[tuple[int, int]]:
    """(number, version) of the finished snapshots, ascending."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/snapshot=*/version=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    names = [str(f.getPath()).split("/")[-3:-1] for f in found]
    return sorted((int(n.split("=")[1]), int(v.split("=")[1])) for n, v in names)


def load(spark: SparkSession, folder: str, version: int, upgrades: dict[int, Upgrade], empty: str) -> DataFrame:
    """The last snapshot in the schema of ``version``: ``upgrades[v]`` turns version v into v + 1; without a snapshot an empty table.

    A snapshot of a later version, or one whose upgrade is missing, raises.
    """
    found = snapshots(spark, folder)
    if not found:
        return spark.createDataFrame([], empty)
    number, have = found[-1]
    if have > version:
        raise ValueError(f"snapshot {number} has version {have}, later than {version}")
    state = spark.read.parquet(f"{folder}/snapshot={number}/version={have}")
    for v in range(have, version):
        if v not in upgrades:
            raise ValueError(f"no upgrade from version {v}")
        state = upgrades[v](state)
    return state


def conflicting(held: DataFrame, new: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """key and what differs (an array of column names): rows of both whose values that must not change do."""
    old = held.select(key, *[F.col(c).alias(f"_{c}") for c in kept])
    differs = F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), F.lit(c)) for c in kept]), lambda x: x.isNotNull())
    return new.join(old, key).select(key, differs.alias("differs")).where(F.size("differs") > 0)


def resume(order: DataFrame, position: str, consumed: int, size: int) -> DataFrame:
    """The next ``size`` rows of an order after ``consumed`` of them; the position is all a loader has to keep."""
    return order.where((F.col(position) >= consumed) & (F.col(position) < consumed + size)).orderBy(position)


def consumed_upto(log: DataFrame, epoch: str, count: str) -> DataFrame:
    """epoch, consumed: where each epoch of a loader stands by its log of finished batches."""
    return log.groupBy(epoch).agg(F.sum(count).alias("consumed"))


__all__ = ["conflicting", "consumed_upto", "load", "resume", "save", "snapshots"]
