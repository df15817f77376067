"""Python workers that get little at a time and give back what a task has used."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import SparkSession

Batches = Iterator[pa.RecordBatch]


def _release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library alone
    if trim:
        trim(0)


def lean(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run`` for a task, after which the worker keeps no memory that it does not use.

    Workers outlive their tasks, and an executor has several of them: one that waits should
    not hold what its last task needed.
    """

    def freed(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            _release()

    return freed


BATCH_BYTES = 4 * 1024 * 1024  # of rows on their way to Python
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, at_most: int = BATCH_BYTES) -> Iterator[None]:
    """Rows of the jobs inside go to Python in batches of ``at_most`` bytes, or one row if that is larger.

    Rows are counted otherwise, and ten thousand long ones are a task's whole share, three times: in
    the executor, in the worker, and as Python objects.
    """
    before = spark.conf.get(_BYTES)
    spark.conf.set(_BYTES, at_most)
    try:
        yield
    finally:
        spark.conf.set(_BYTES, before)
