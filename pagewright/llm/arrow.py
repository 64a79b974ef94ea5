"""Batches of texts on the way through Python workers, in pieces of bounded size."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch between Spark and its Python workers.
BATCH_BYTES = 4 << 20
#: Text bytes that one piece holds, unless a single text is longer.
PIECE_BYTES = 8 << 20


def binary(column: pa.Array) -> pa.Array:
    """The UTF-8 bytes of a text column, null as empty; no copy of the data where there are no nulls."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    return column.cast(pa.large_binary())


def pieces(batches: Iterator[pa.RecordBatch], text: int, size: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the column at index text holds about size bytes each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(_lengths(binary(batch.column(text))))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _lengths(column: pa.Array) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    return np.diff(offsets)


def lists(values: bytes, counts: list[int], dtype: str = "<i4") -> pa.Array:
    """A list array of len(counts) rows from the bytes of all values."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(values, dtype=dtype)))


def tidy() -> None:
    """Gives memory that is free back to the system, so that a worker's next task finds it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A small table of values that the driver holds, made by the JVM: from Python rows it would start workers of its own on each executor."""
    return spark.createDataFrame(pa.table(columns))


def small_batches(spark: SparkSession) -> None:
    """Holds the session's Arrow batches to BATCH_BYTES, so that long texts do not add up to batches of any size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key, str(1 << 30))).rstrip("b") or 0) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def one_thread() -> None:
    """Keeps matrix products of this process to one thread, as a task has one core; a library without the call stays as it is."""
    paths: set[str] = set()
    with contextlib.suppress(OSError), open("/proc/self/maps", encoding="utf-8") as f:
        paths = {line.split()[-1] for line in f if "openblas" in line}
    for path in paths:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break
