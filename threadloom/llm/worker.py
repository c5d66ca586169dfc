"""Running Arrow kernels in Python workers that live long and share little memory.

Workers are reused by tasks of other stages, so what a stage caches is dropped when a
task of another stage begins, and freed memory goes back to the system after each
task. Batches are cut to ``ROWS`` rows before a kernel sees them, and while a table is
staged Spark's own batches are as small (``staging.small_batches``).
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import TypeVar

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

ROWS = 2000
_STAGE: list[int] = []
_CACHE: dict[object, object] = {}
T = TypeVar("T")


def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: memory is returned when it likes
        return None


def _enter() -> None:
    context = TaskContext.get()
    stage = context.stageId() if context else -1
    if _STAGE != [stage]:
        _STAGE[:] = [stage]
        _CACHE.clear()
        _leave()


def _leave() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if libc := _libc():
        libc.malloc_trim(0)


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the cyclic collector, for code that makes many small objects and no cycles."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def cached(key: object, make: Callable[[], T]) -> T:
    """An object that tasks of one stage share in a worker."""
    if key not in _CACHE:
        _CACHE[key] = make()
    return _CACHE[key]


def map_arrow(df: DataFrame, kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with small batches and with memory given back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _enter()
        yield from kernel(b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS))
        _leave()

    return df.mapInArrow(run, schema)
