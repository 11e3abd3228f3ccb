"""Tables, staged results and blocks of rows for the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterator
from typing import TypeVar

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnlens.operators.skew import shared_folder, stage

__all__ = ["columns_of", "default_parts", "held", "release", "row_blocks", "shared_folder", "stage", "table"]

BLOCK_BYTES = 6 << 20

Model = TypeVar("Model")
_held: dict[Hashable, object] = {}


def trim() -> None:
    """Give memory that isn't used any more back to the system; a worker lives on between tasks."""
    pa.default_memory_pool().release_unused()
    if give_back := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU library
        give_back(0)


def release() -> None:
    """Drop the model that an earlier task left in this worker."""
    if _held:
        _held.clear()
        trim()


def held(key: Hashable, make: Callable[[], Model]) -> Model:
    """What ``make`` gives, kept for later tasks of this worker until a task needs another model or none."""
    if key not in _held:
        release()
        _held[key] = make()
    return _held[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever their names contain."""
    return [F.col(f"`{name}`") for name in df.columns]


def default_parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_blocks(
    batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into blocks of whole rows with about ``most`` bytes in ``column``.

    A row that is longer than that is a block of its own, so memory follows the longest row.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = size_so_far = 0
        for i, size in enumerate(sizes):
            if size_so_far and size_so_far + size > most:
                yield batch.slice(start, i - start)
                start, size_so_far = i, 0
            size_so_far += size
        if len(sizes) > start:
            yield batch.slice(start)
        del batch  # else it stays while the next one is read
    trim()
