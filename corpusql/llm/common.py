"""Helpers shared by the operators: shared-folder tables and byte arrays of texts.

Texts are handled inside Arrow batches as one byte array with document offsets, cut
into pieces of whole documents so that the working arrays of a task stay small. A
single document longer than a piece is a piece of its own.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from corpusql.session import shared_root

PIECE_BYTES = 1 << 19


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back: lineage ends
    there, so a lost executor re-reads files instead of recomputing the job."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(df: DataFrame, bytes_each: int) -> int:
    """A partition count that follows the bytes ``df`` is expected to read; at least the
    session's, which also stands where the size is unknown."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return usual if size >= 1 << 60 else max(usual, -(-size // bytes_each))


# --- texts of an Arrow batch as byte arrays --------------------------------------

def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, document offsets) of a string or binary column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary()
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    column = column.view(wide) if pa.types.is_large_string(column.type) else column.cast(wide)
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0]:at[-1]], at - at[0]


def pieces(column: pa.Array, most: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole documents of
    about ``most`` bytes."""
    data, at = text_bytes(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, data[at[i]:at[j]], at[i:j + 1] - at[i]
        i = j


def is_space(data: np.ndarray) -> np.ndarray:
    """Bytes 0x20 and 0x09 to 0x0D."""
    return (data == 0x20) | ((data - np.uint8(9)) <= 4)


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document offsets in words) of the runs of other bytes than
    ``is_space``; no run crosses a document's end."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~is_space(data)
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words with one space behind each, and where they start in that."""
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts + 1, out=at[1:])
    out = np.full(at[-1], 0x20, np.uint8)
    step = np.zeros(len(data) + 1, np.int8)
    step[starts] += 1
    step[ends] -= 1
    letters = np.ones(at[-1], bool)
    letters[at[1:] - 1] = False
    out[letters] = data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
    return out.tobytes(), at


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64."""
    if len(_POWERS[0]) <= n:
        size = max(n + 1, PIECE_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            _POWERS[k] = np.cumprod(x, dtype=np.uint64)
    return _POWERS[0][:n + 1], _POWERS[1][:n + 1]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of ``values[start:end]``, the same wherever the span lies."""
    up, down = _powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts])


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mixed((sums[width:] - sums[:-width]) * down[:n])


def least_of_runs(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every run of ``width``."""
    best, span = values, 1
    while span < width:          # doubling: a longer run is two overlapping shorter ones
        step = min(span, width - span)
        best = np.minimum(best[step:], best[:len(best) - step])
        span += step
    return best


def release_memory() -> None:
    """Returns freed memory to the system; ``malloc_trim`` is glibc's way to."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` that gives a task's memory back when it ends: idle Python workers are kept for
    later tasks, and several of them share an executor's memory."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()
    return task


def by_batch(make: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]):
    """A ``mapInArrow`` function from one that takes a single batch."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from make(batch)
    return lean(run)
