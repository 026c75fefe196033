"""Words of UTF-8 texts as 64-bit hashes, computed with numpy over whole Arrow batches.

A batch is handled in runs of rows of about ``RUN_BYTES`` bytes of text (a longer text is a run of
its own), so temporary arrays stay bounded whatever the size of a batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 20

U = np.uint64
_ODD = U(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all output bits."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def chain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of the pair (left, right); order matters."""
    return mix(left * _ODD + right)


def _byte_values() -> np.ndarray:
    """A random 64-bit value for each byte; A-Z count as a-z."""
    values = mix((np.arange(256, dtype=U) + U(1)) * _ODD)
    values[0x41:0x5B] = values[0x61:0x7B]
    return values


BYTE_VALUES = _byte_values()


def release() -> None:
    """Give memory that is no longer used back to the system: workers are kept for later tasks, which
    may need it elsewhere."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def byte_class(inside: Iterator[int] | range | bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(inside)] = True
    return table


#: Bytes inside words: everything but white space.
NOT_BLANK = ~byte_class(bytes([0x20, *range(0x09, 0x0E)]))
#: Digits, letters and everything beyond ASCII.
ALNUM = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as far as needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = pow(_BASE, -1, 1 << 64)
            up, down = np.full(size, U(_BASE)), np.full(size, U(inverse))
            up[0] = down[0] = U(1)
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


_powers = _Powers()


def texts(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string array; null is the empty text."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if not len(array):
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    array = pc.fill_null(array, "") if array.null_count else array
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    return offsets, np.frombuffer(data if data is not None else b"", dtype=np.uint8)


def runs(array: pa.Array, run_bytes: int = RUN_BYTES, run_rows: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(first row, offsets from 0, bytes)`` of consecutive rows."""
    offsets, data = texts(array)
    row, n = 0, len(offsets) - 1
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + run_bytes, side="right")) - 1
        end = min(max(end, row + 1), n, row + run_rows)
        yield row, offsets[row : end + 1] - offsets[row], data[offsets[row] : offsets[end]]
        row = end


def word_bounds(offsets: np.ndarray, data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word, in order. Words do not cross rows."""
    held = inside[data]
    if not len(held):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    before = np.empty(len(held), dtype=bool)
    before[0], before[1:] = False, held[:-1]
    before[offsets[:-1][offsets[:-1] < len(held)]] = False
    after = np.empty(len(held), dtype=bool)
    after[-1], after[:-1] = False, held[1:]
    ends_of_rows = offsets[1:][offsets[1:] > 0]
    after[ends_of_rows - 1] = False
    starts = np.flatnonzero(held & ~before)
    ends = np.flatnonzero(held & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each ``data[start:end]``; equal strings (but for the case of A-Z) have equal hashes."""
    up, down = _powers.upto(len(data) + 1)
    sums = np.empty(len(data) + 1, dtype=U)
    sums[0] = 0
    np.cumsum(BYTE_VALUES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(U))


def word_hashes(offsets: np.ndarray, data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of each word, in order."""
    starts, ends, rows = word_bounds(offsets, data, inside)
    return span_hashes(data, starts, ends), rows


def row_counts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


class HashTable:
    """Positions of distinct, well mixed 64-bit keys; a bounded table of about 24 bytes a key."""

    def __init__(self, keys: np.ndarray) -> None:
        bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.shift, self.mask = keys, U(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, dtype=np.int32)
        waiting = np.arange(len(keys))
        at = (keys >> self.shift).astype(np.int64)
        while len(waiting):
            free = self.slots[at] < 0
            spots, first = np.unique(at[free], return_index=True)
            self.slots[spots] = waiting[free][first]
            left = np.ones(len(waiting), dtype=bool)
            left[np.flatnonzero(free)[first]] = False
            waiting, at = waiting[left], (at[left] + 1) & self.mask

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Position of each key, -1 where there is none."""
        found = np.full(len(wanted), -1, dtype=np.int32)
        if not len(self.keys):
            return found
        at = (wanted >> self.shift).astype(np.int64)
        here = self.slots[at]
        same = (here >= 0) & (self.keys[here] == wanted)
        found[same] = here[same]
        open_ = np.flatnonzero((here >= 0) & ~same)
        at = at[open_]
        while len(open_):
            at = (at + 1) & self.mask
            here = self.slots[at]
            same = (here >= 0) & (self.keys[here] == wanted[open_])
            found[open_[same]] = here[same]
            going = (here >= 0) & ~same
            open_, at = open_[going], at[going]
        return found
