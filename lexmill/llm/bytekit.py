"""Vectorised word and shingle kernels over Arrow string buffers.

Every kernel works on the UTF-8 bytes of a slice of rows at once, so a
Python worker never loops over characters or words.  Slices are bounded in
bytes (one row at least), which bounds a worker's memory whatever the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 19
Batches = Iterator[pa.RecordBatch]


def tidy(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A batch function whose worker gives its freed memory back when a task ends, as idle workers live on."""

    def tidied(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return tidied

_MASK = (1 << 64) - 1


def _byte_table(lowered: bool) -> np.ndarray:
    """One odd pseudo-random 64-bit number per byte; with ``lowered``, A-Z share those of a-z."""
    table = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    if lowered:
        table[65:91] = table[97:123]
    return table


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection on 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


CASED = _byte_table(False)
LOWERED = _byte_table(True)
_BASE = 0x2545F4914F6CDD1D
_STEP = 0xD6E8FEB86659FD93


def class_table(*spans: tuple[int, int], inverted: bool = False) -> np.ndarray:
    """A boolean table over bytes: true inside the inclusive spans (outside when inverted)."""
    table = np.zeros(256, dtype=bool)
    for lo, hi in spans:
        table[lo : hi + 1] = True
    return ~table if inverted else table


#: Words between white space: ``[^\x20\x09-\x0D]+``.
SPACED = class_table((0x20, 0x20), (0x09, 0x0D), inverted=True)
#: Words of letters, digits and non-ASCII characters after lower-casing A-Z.
ALNUM = class_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


@dataclass
class Texts:
    """Rows ``lo`` to ``hi`` of a batch: their bytes, and the offsets of each row in them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo


def slices(column: pa.Array, target: int = SLICE_BYTES) -> Iterator[Texts]:
    """The rows of a string or binary column in slices of about ``target`` bytes; nulls read as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    binary = pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)
    column = pc.fill_null(column.cast(pa.large_binary()), b"") if binary else pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + target, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield Texts(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


@dataclass
class Words:
    """Words of a slice in text order: byte starts and ends, row, and the first word of each row."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    first: np.ndarray  # rows + 1 entries

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(texts: Texts, table: np.ndarray) -> Words:
    inside = table[texts.data]
    n = len(inside)
    edge = texts.offsets[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    before = np.empty(n, dtype=bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
        before[edge] = False
    start = np.flatnonzero(inside & ~before)
    after = np.empty(n, dtype=bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
        after[edge - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, texts.offsets, side="left")
    row = np.repeat(np.arange(texts.rows), np.diff(first))
    return Words(start, end, row, first)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span (spans in order, not overlapping, none empty)."""
    if not len(start):
        return np.empty(0, np.uint64)
    size = end - start
    begin = np.zeros(len(size), dtype=np.int64)
    np.cumsum(size[:-1], out=begin[1:])
    at = np.arange(int(begin[-1] + size[-1]), dtype=np.int64)
    inside = at - np.repeat(begin, size)
    powers = _powers(int(size.max()))
    value = table[data[at + np.repeat(start - begin, size)]] * powers[inside]
    return mix64(np.add.reduceat(value, begin) + size.astype(np.uint64))


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        out = np.full(max(n, 256), _BASE, dtype=np.uint64)
        out[0] = 1
        _POWERS = np.multiply.accumulate(out)
    return _POWERS


def windows(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words inside one row, and the index of their first words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    value = np.zeros(n, np.uint64)
    for j in range(width):
        value += hashes[j : j + n] * np.uint64(pow(_STEP, j + 1, 1 << 64))
    row_end = np.repeat(first[1:], np.diff(first))[:n]
    at = np.flatnonzero(np.arange(n) + width <= row_end)
    return mix64(value[at] + np.uint64(width)), at


def key_in_row(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Hashes that tell equal values in different rows apart."""
    return mix64(hashes ^ mix64(row.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)))
