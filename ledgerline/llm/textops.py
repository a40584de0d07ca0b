"""Vectorised work on the bytes of a batch of texts (numpy over Arrow buffers)."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer document is one piece of its own.
PIECE = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit constants that follow from the seed alone."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed << 20)) * _U(0x9E3779B97F4A7C15)) | _U(1)


_BYTE = constants(256, 11)
_GRAM = constants(64, 12)


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row and the offsets between them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.empty(0, np.uint8)
    return data, off - off[0]


def pieces(data: np.ndarray, off: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) for runs of texts that together hold about `most` bytes."""
    first, n = 0, len(off) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(off, off[first] + most, "right")) - 1)
        yield first, last, data[off[first] : off[last]], off[first : last + 1] - off[first]
        first = last


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n at least."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _powers:
        if size > 2 * PIECE:
            _powers.clear()  # a table of this size is rarely needed again
        up, down = np.full(size, _U(_BASE)), np.full(size, _U(_INVERSE))
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def prefix(data: np.ndarray) -> np.ndarray:
    """Sums S with which span() hashes any stretch of the bytes in constant time."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * up[: len(data)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the stretches [start, end)."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))


def lowered(data: np.ndarray) -> np.ndarray:
    """The bytes with A-Z in lower case."""
    upper = (data >= 65) & (data <= 90)
    return data + (upper * np.uint8(32)).astype(np.uint8)


def words(data: np.ndarray, off: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the index of each text's first word (one more at the end).

    gap: for each byte whether it stands between words. Words end with their text.
    """
    n = len(data)
    if not n:
        none = np.empty(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    inside, edge = ~gap[data], np.zeros(n + 1, bool)
    edge[off] = True
    start, end = inside.copy(), inside.copy()
    turn = edge[1:n]
    start[1:] &= ~inside[:-1] | turn
    end[:-1] &= ~inside[1:] | turn
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    return start, end, np.searchsorted(start, off)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes at every place where k follow."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, _U)
    out = hashes[:n] * _GRAM[0]
    for j in range(1, k):
        out = out + hashes[j : j + n] * _GRAM[j]
    return mix(out + _U(k))


def gaps(expression: str) -> np.ndarray:
    """Table over bytes from the characters that separate words."""
    out = np.zeros(256, bool)
    out[[ord(c) for c in expression]] = True
    return out


def trimmed(run: Callable) -> Callable:
    """A function over batches that gives its memory back to the system when it is through.

    Python workers are kept for later tasks; what they have freed but not returned would
    otherwise stand beside the memory of the next stage.
    """

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped
