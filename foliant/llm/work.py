"""Scratch tables that free what is over, and Arrow batch limits for the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from foliant.operators import scratch
from foliant.operators.scratch import BATCH_BYTES


class Scratch(scratch.Scratch):
    """Tables of one operator call below the shared folder, deleted when the session's process ends."""

    def sweep(self, *names: str) -> None:
        """Drops tables that no later step reads, gives freed memory back and lets Spark delete the shuffle files of jobs that are over.

        Spark deletes those only when the driver collects garbage, which a driver that just waits may not do for long.
        """
        for name in names:
            self.drop(name)
        release()
        self.spark.sparkContext._jvm.System.gc()


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow``; Spark bounds the batches in rows and bytes, ``Scratch.write`` more tightly than by default."""
    return df.mapInArrow(_tidy(fn), schema)


def _tidy(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` on batches of at most BATCH_BYTES or one row, after which the worker gives freed memory back.

    Workers are used again, and several live on one executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(_slices(batches))
        finally:
            release()

    return run


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = max(1, batch.num_rows * BATCH_BYTES // max(batch.nbytes, BATCH_BYTES))
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def release() -> None:
    """Returns what Arrow's pool and the C library hold free to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def tasks(spark: SparkSession) -> int:
    """Partitions for an explicit shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
