"""What the operators of this subpackage share: the shared folder, Arrow helpers, names that can't clash."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from depweave.session import materialise, scratch_path

__all__ = ["Sheltered", "flat", "give_back", "lean", "materialise", "pieces_of", "scratch_path", "small_batches", "text_bytes"]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand Python workers fewer rows at a time than the default of 10,000, so that long texts fit; a setting of the user's own stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for mapInArrow, but memory that it freed goes back to the system when a task ends: idle workers stay small."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def give_back() -> None:
    """Freed memory goes back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not a GNU C library
        ctypes.CDLL(None).malloc_trim(0)


def text_bytes(name: str = "text") -> Column:
    """The column as UTF-8 bytes, null as empty: Arrow then hands over bytes without validating them."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a binary or string column without copies; offsets count from the start of the bytes. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def pieces_of(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows with about ``most`` bytes of the column each: bounds memory, not the text."""
    size = np.diff(flat(batch.column(column))[0])
    cut = (np.cumsum(size) - size) // most
    starts = np.flatnonzero(np.diff(cut, prepend=-1))
    for a, b in zip(starts, [*starts[1:], len(size)], strict=True):
        yield batch.slice(a, b - a)


class Sheltered:
    """A table under names that no operator uses (c0, c1, ...), so that no column of the user's can clash with a helper's.

    Columns that the result makes anew (``made``, whatever their case) are left out, unless they are in ``needed``.
    """

    def __init__(self, docs: DataFrame, made: Iterable[str] = (), needed: Iterable[str] = ()):
        self._at = {}
        for i, c in enumerate(docs.columns):
            self._at.setdefault(c, f"c{i}")
            self._at.setdefault(c.lower(), f"c{i}")
        wanted, gone = {self.of(c) for c in needed}, {m.lower() for m in made}
        kept = [(f"c{i}", c) for i, c in enumerate(docs.columns) if f"c{i}" in wanted or c.lower() not in gone]
        #: Columns that the result carries on: their names here, and their own.
        self.inner = [i for i, c in kept if c.lower() not in gone]
        self.names = [c for _, c in kept if c.lower() not in gone]
        self.docs = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).select(*(i for i, _ in kept))

    def of(self, name: str) -> str:
        return self._at[name] if name in self._at else self._at[name.lower()]
