"""Whole Arrow string columns to word hashes in NumPy, without a Python object for each word.

A word is a maximal run of 0-9, a-z or any character from U+0080, after A-Z became a-z. A word's hash is a
polynomial over random 64-bit values of its bytes, finished by a mixer; texts are read in pieces of about
PIECE bytes, so memory is a small multiple of PIECE, or of one document's words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 18
_LOWER = np.zeros(256, np.uint8)
for _b in range(256):
    if 0x30 <= _b <= 0x39 or 0x61 <= _b <= 0x7A or _b >= 0x80:
        _LOWER[_b] = _b
    elif 0x41 <= _b <= 0x5A:
        _LOWER[_b] = _b + 0x20
WORD_TABLE = bytes(int(x) or 0x20 for x in _LOWER)
"""bytes.translate() with this, then split(), gives the words of one text."""
_VALUES = np.random.default_rng(0x5EED).integers(1, 2**63, 256, np.uint64) | np.uint64(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, PIECE)
        tables = []
        for base in (_P, _P_INV):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        _powers[:] = tables
    return _powers


def _piece_hashes(raw: np.ndarray, bounds: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, ...]:
    """Starts, ends and hashes of the words of raw (no word crosses one of the bounds), then hashes of their prefixes."""
    low = _LOWER[raw]
    on = low != 0
    before = np.empty_like(on)
    before[0] = False
    before[1:] = on[:-1]
    after = np.empty_like(on)
    after[-1] = False
    after[:-1] = on[1:]
    inner = bounds[(bounds > 0) & (bounds < len(raw))]
    before[inner] = False
    after[inner - 1] = False
    starts = np.flatnonzero(on & ~before)
    ends = np.flatnonzero(on & ~after) + 1
    power, inverse = _power_tables(len(raw))
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_VALUES[low] * power[: len(raw)], out=total[1:])
    size = np.uint64(0xD6E8FEB86659FD93)
    hashes = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * size)
    out = [starts, ends, hashes]
    for n in prefixes:
        stop = np.minimum(starts + n, ends)
        part = mix((total[stop] - total[starts]) * inverse[starts] + np.uint64((n << 40) * int(size) & 0xFFFFFFFFFFFFFFFF))
        part[ends - starts <= n] = 0
        out.append(part)
    return tuple(out)


class Words(NamedTuple):
    """Words of documents first..last-1 of a column: byte spans in the column's data, hashes, first word of each document."""

    first: int
    last: int
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    doc: np.ndarray
    data: np.ndarray
    offsets: np.ndarray
    prefixes: tuple[np.ndarray, ...] = ()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (one more than rows) and bytes of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def groups(offsets: np.ndarray, piece: int = PIECE) -> Iterator[tuple[int, int]]:
    """Consecutive documents of about piece bytes; a longer one stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + piece, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def _cut(data: np.ndarray, lo: int, hi: int) -> int:
    """The end of a piece that starts at lo: at a separator, if there is one, else at the next one."""
    end = lo + PIECE
    if end >= hi:
        return hi
    seps = np.flatnonzero(_LOWER[data[lo:end]] == 0)
    if len(seps):
        return lo + int(seps[-1]) + 1
    while end < hi:
        seps = np.flatnonzero(_LOWER[data[end : min(end + PIECE, hi)]] == 0)
        if len(seps):
            return end + int(seps[0]) + 1
        end += PIECE
    return hi


def iter_words(column: pa.Array, prefixes: tuple[int, ...] = ()) -> Iterator[Words]:
    """Words of about PIECE bytes at a time; prefixes: also hashes of so many first bytes of each longer word (else 0)."""
    offsets, data = buffers(column)
    for first, last in groups(offsets):
        lo, hi = int(offsets[first]), int(offsets[last])
        bounds = offsets[first : last + 1]
        parts: list[tuple[np.ndarray, ...]] = []
        at = lo
        while at < hi:
            end = hi if last - first > 1 else _cut(data, at, hi)
            s, e, *h = _piece_hashes(data[at:end], bounds - at, prefixes)
            parts.append((s + at, e + at, *h))
            at = end
        if parts:
            starts, ends, hashes, *more = (np.concatenate(x) if len(parts) > 1 else x[0] for x in zip(*parts, strict=True))
        else:
            starts, ends, hashes, more = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), [np.zeros(0, np.uint64)] * len(prefixes)
        yield Words(first, last, starts, ends, hashes, np.searchsorted(starts, bounds), data, offsets, tuple(more))


_SHINGLE = np.random.default_rng(0xC0DE).integers(1, 2**63, 64, np.uint64) | np.uint64(1)


def shingles(w: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of width words inside a document, and each document's first one (one more than documents).

    A document of fewer words, but not none, has one run: all its words.
    """
    n = len(w.hashes)
    sizes = np.diff(w.doc)
    counts = np.where(sizes >= width, sizes - width + 1, np.minimum(sizes, 1))
    first = np.concatenate([[0], np.cumsum(counts)])
    if n >= width:
        acc = w.hashes[: n - width + 1] * _SHINGLE[0]
        for k in range(1, width):
            acc += w.hashes[k : n - width + 1 + k] * _SHINGLE[k]
        acc = mix(acc)
    else:
        acc = np.zeros(0, np.uint64)
    at = np.repeat(w.doc[:-1] - first[:-1], counts) + np.arange(first[-1])
    out = np.empty(int(first[-1]), np.uint64)
    long = np.repeat(sizes >= width, counts)
    out[long] = acc[at[long]]
    for d in np.flatnonzero((sizes > 0) & (sizes < width)):
        part = w.hashes[w.doc[d] : w.doc[d + 1]]
        value = (part * _SHINGLE[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
        out[first[d]] = mix(np.array([value], np.uint64))[0]
    return out, first


def words_of(text: str | None) -> list[bytes]:
    """The words of one text, as bytes."""
    return (text or "").encode("utf-8", "replace").translate(WORD_TABLE).split()
