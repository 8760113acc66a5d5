"""Scratch tables in the folder that driver and executors share.

Executors can be lost at any time, so lineage is cut only with tables written to that folder
(``spark.checkpoint.dir``). A folder of our own is made only where that setting is absent and everything runs on
one machine, as in tests.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch handed to a Python worker; long texts make batches small.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors. Where none is set, a temporary one, but only for a local master."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{_own_folder()}"
    return found.rstrip("/")


@functools.lru_cache(1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="foliant-")


@contextlib.contextmanager
def batch_limits(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[None]:
    """Bounds Arrow batches in rows and bytes while a job runs; the session's own settings come back after it."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": str(size)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Scratch:
    """Tables of one operator call below the shared folder, deleted when the session's process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, rows: int = BATCH_ROWS) -> DataFrame:
        with batch_limits(self.spark, rows):
            df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        try:
            jvm = self.spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001  the session may have ended; the folder is scratch space
            pass
