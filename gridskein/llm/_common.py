"""Shared helpers: reading tables, row keys, and the library's storage of intermediate results."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialise, shared_dir

__all__ = ["discard", "freeing", "groups_of", "keyed", "materialise", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; any store that Spark reads will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Add ``__id`` and ``__th``: together they tell rows apart that differ in id or text.

    Rows equal in both get equal results in every operator here, so they may share the key.
    """
    return df.withColumns(
        {"__id": F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), "__th": F.xxhash64(F.col(f"`{text_col}`"))}
    )


def groups_of(sizes: Iterable[int], limit: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of consecutive items with no more than ``limit`` in all, or of one item that has more."""
    first, have, k = 0, 0, -1
    for k, size in enumerate(sizes):
        if k > first and have + size > limit:
            yield first, k
            first, have = k, 0
        have += size
    if k >= first:
        yield first, k + 1


def freeing(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The kernel ``rows``; at its end the memory that its worker holds unused goes back to the system.

    Workers live on for later tasks: what one kernel leaves would otherwise add to what the next one needs.
    """

    @wraps(rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from rows(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # Python's and numpy's; other C libraries than glibc have none
            if trim:
                trim(0)

    return run
