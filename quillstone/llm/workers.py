"""Python workers live on between tasks and operators; these keep what they hold small."""

from __future__ import annotations

import ctypes
import functools
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa


def release() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], tokens: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which free memory goes back; unless it needs tokens, a tokenizer kept from another operator goes too."""

    @functools.wraps(run)
    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = sys.modules.get("quillstone.llm.tokens")
        if kept and not tokens:
            kept._encoders.clear()
        try:
            yield from run(batches)
        finally:
            release()

    return inner


def with_texts(batch: pa.RecordBatch, changed: dict[int, str]) -> pa.RecordBatch:
    """batch with new texts in some rows; n_chars, if there, follows them."""
    if not changed:
        return batch
    arrays = []
    for name in batch.schema.names:
        c = batch.column(name)
        if name in ("text", "n_chars"):
            values = c.to_pylist()
            for i, t in changed.items():
                values[i] = t if name == "text" else len(t)
            c = pa.array(values, c.type)
        arrays.append(c)
    return pa.RecordBatch.from_arrays(arrays, schema=batch.schema)
