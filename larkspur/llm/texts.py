"""Texts of an Arrow column as UTF-8 bytes, and the memory that work on them leaves."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa


def text_at(column: pa.Array) -> Iterator[bytes | None]:
    """Each text's bytes, None for null, without decoding."""
    large = pa.types.is_large_string(column.type)
    for x in column.cast(pa.large_binary() if large else pa.binary()):
        yield x.as_py()


def give_back() -> None:
    """Return what this process has freed to the system: Arrow and the C library keep it, and
    workers outlive their tasks, so that each would count at its highest until it ends."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving memory back when a task ends."""

    def run_and_trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return run_and_trim
