"""One scan, several independent queries; unions of files and batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@contextmanager
def fan_out(df: DataFrame, branches: dict[str, Callable[[DataFrame], DataFrame]], columns: Sequence[str] | None = None) -> Iterator[dict[str, DataFrame]]:
    """Run several queries over one pruned scan that is kept (memory, then disk) while the block runs."""
    shared = (df.select(*columns) if columns else df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield {name: branch(shared) for name, branch in branches.items()}
    finally:
        shared.unpersist()


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames; a column that one lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def tagged_union(frames: dict[str, DataFrame], tag: str = "query") -> DataFrame:
    return union_all([df.withColumn(tag, F.lit(name)) for name, df in frames.items()])
