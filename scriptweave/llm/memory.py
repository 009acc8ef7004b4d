"""Keeping the memory of Python workers and Arrow batches small."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of few bytes for the jobs run inside, as a task holds several copies of one. The session's
    own setting stands again behind it; it has no other effect on jobs that run meanwhile."""
    before = spark.conf.get(_BATCH_SETTING)
    spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(_BATCH_SETTING, before)


def released(items: Iterator) -> Iterator:
    """The items; before the first and behind the last, memory that is no longer used goes back to the system.
    Workers are used again, and would keep it for the tasks of other operators."""
    _release()
    try:
        yield from items
    finally:
        _release()


def _release() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
