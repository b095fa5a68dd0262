"""Shared plumbing: staging tables in the cluster's shared folder, checked broadcasts, splitting Arrow batches."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import staged

__all__ = ["BROADCAST_ROWS", "byte_chunks", "checked_join", "few_rows", "give_back", "staged", "table", "texts_of", "tidy"]

#: Largest number of rows that checked_join() broadcasts.
BROADCAST_ROWS = 100_000
#: Text bytes handled at once inside a Python worker.
CHUNK_BYTES = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checked_join(big: DataFrame, small: DataFrame, key: str, how: str = "left", salts: int = 64) -> DataFrame:
    """big joined to a table with one row per key.  The small side is broadcast only when its counted rows stay under
    BROADCAST_ROWS; beyond that both sides are shuffled with the big side's keys salted, so a hot key is spread.  The
    salt is a hash of the whole row, so a task that runs again deals its rows out as before."""
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")).join(salted, [key, "_salt"], how).drop("_salt")


def tidy(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f for mapInArrow, whose task gives its memory back when it ends.  Python workers outlive tasks and stages; without
    this each of them keeps the most that any of its tasks held."""

    @functools.wraps(f)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    """Memory that nothing uses any more goes to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


@contextmanager
def few_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows, for what is computed inside the block."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def byte_chunks(texts: pa.Array, limit: int = CHUNK_BYTES, rows: int = 10_000) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow string column: at most `rows` texts that add up to about `limit` bytes (a longer text
    stands alone)."""
    sizes = pc.binary_length(texts)
    start = total = 0
    for k, n in enumerate(sizes.to_pylist()):
        n = n or 0
        if k > start and (total + n > limit or k - start >= rows):
            yield start, k
            start, total = k, 0
        total += n
    if start < len(texts):
        yield start, len(texts)


def texts_of(column: pa.Array, start: int = 0, stop: int | None = None) -> list[str]:
    """Texts as Python strings; null counts as empty."""
    return [t or "" for t in column.slice(start, None if stop is None else stop - start).to_pylist()]
