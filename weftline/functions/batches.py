"""Arrow batches of stages in Python: bounded by bytes, and their memory given back."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of the batches that texts travel in between the JVM and Python.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds this session's Arrow batches by bytes, unless somebody set a bound: by rows alone, a batch of long texts has any size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def tidied(run):
    """``run`` for ``mapInArrow``; when a task is done, its worker gives memory that it no longer uses back to the system."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim is not None:
                trim(0)

    return tidy
