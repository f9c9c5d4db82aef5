"""Memory of Python workers, which Spark keeps alive for later tasks and stages, and of the batches they are sent."""

from __future__ import annotations

import contextlib
import ctypes
import functools

import pyarrow as pa
from pyspark.sql import SparkSession

_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"

try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # a C library without it
    _trim = None


def give_back() -> None:
    """Return what the allocators of Arrow and C hold unused to the system."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


@contextlib.contextmanager
def small_batches(spark: SparkSession, size: int = 8 << 20):
    """Arrow batches of at most ``size`` bytes (or one row) for what runs inside; a batch is held several times, by both
    sides and while its buffers grow. Results don't depend on it."""
    before = spark.conf.get(_BATCH, None)
    spark.conf.set(_BATCH, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_BATCH)
        else:
            spark.conf.set(_BATCH, before)


def frugal(run):
    """``run`` over the batches of a partition, giving back its memory when the partition ends."""
    @functools.wraps(run)
    def held(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return held
