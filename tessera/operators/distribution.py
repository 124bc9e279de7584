"""Distributed arrays are partitioned DataFrames: distribution by value, range, hash, chance or place, and work slot by slot."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def distribute_hash(df: DataFrame, slots: int, *names: str) -> DataFrame:
    return df.repartition(slots, *names)


def distribute_random(df: DataFrame, slots: int) -> DataFrame:
    return df.repartition(slots)


def distribute_range(df: DataFrame, slots: int, *names: str) -> DataFrame:
    """Slots hold ranges of keys, so sorted slots in turn are sorted."""
    return df.repartitionByRange(slots, *names)


def distribute_grid(df: DataFrame, slots: int, x: Column, y: Column, size: float) -> DataFrame:
    """Rows of one grid cell are in one slot."""
    return df.repartition(slots, F.floor(x / size), F.floor(y / size))


def dmap(df: DataFrame, f: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str) -> DataFrame:
    """f of each Arrow batch of each slot."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from map(f, frames)

    return df.mapInPandas(run, schema)


def lsortby(df: DataFrame, *names: str) -> DataFrame:
    """Sort within slots."""
    return df.sortWithinPartitions(*names)


def slot_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(F.spark_partition_id().alias("slot")).count()


def dsort(df: DataFrame, *names: str) -> DataFrame:
    """A global sort: range partitions, each sorted."""
    return df.orderBy(*names)
