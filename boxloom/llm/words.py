"""Word hashes of many texts at once, as NumPy arrays. Words: ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that one round of array work takes; a longer text is a round of its own.
ROUND_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buffer, offsets


def rounds(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``ROUND_BYTES`` each."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + ROUND_BYTES, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_spans(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in ``buffer[offsets[0]:offsets[-1]]``, and the row that it stands in."""
    base = offsets[0]
    part = buffer[base : offsets[-1]]
    space = (part == 32) | ((part >= 9) & (part <= 13))
    new = np.zeros(len(part) + 1, bool)
    new[offsets - base] = True
    before = np.ones(len(part), bool)
    before[1:] = space[:-1]
    starts = np.flatnonzero(~space & (before | new[:-1]))
    after = np.ones(len(part), bool)
    after[:-1] = space[1:]
    ends = np.flatnonzero(~space & (after | new[1:])) + 1
    row = np.searchsorted(offsets - base, starts, "right") - 1
    return starts, ends, row


def word_hashes(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, finalised with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    odd = np.uint64(2 * seed + 0x9E3779B97F4A7C15 | 1)
    width = ends - starts
    powers = np.cumprod(np.full(int(width.max()), odd))
    total = int(width.sum())
    first = np.cumsum(width) - width
    inside = np.arange(total) - np.repeat(first, width)
    letters = part[inside + np.repeat(starts, width)].astype(np.uint64)
    if lower:
        letters += np.uint64(32) * ((letters >= 65) & (letters <= 90))
    summed = np.add.reduceat((letters + np.uint64(1)) * powers[inside], first)
    return mix(summed ^ (width.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def spans_of(hashes: np.ndarray, count: int) -> np.ndarray:
    """Polynomial hash of every ``count`` consecutive words (fewer than that at the end are cut off)."""
    n = len(hashes) - count + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = np.array([0xC2B2AE3D27D4EB4F], np.uint64)  # an array: its products wrap around without a warning
    # powers of two of the window, joined from the left
    piece, length, done, out = hashes, 1, 0, None
    power = base
    while True:
        if count & length:
            taken = piece[done : done + n]
            out = taken.copy() if out is None else out * power + taken
            done += length
        if done == count:
            return mix(out)
        piece = piece[: len(piece) - length] * power + piece[length:]
        length *= 2
        power = power * power


def sliding_min(values: np.ndarray, count: int) -> np.ndarray:
    """Minimum of every ``count`` consecutive values."""
    n = len(values) - count + 1
    if n <= 0:
        return values[:0]
    length = 1
    while 2 * length <= count:
        values = np.minimum(values[:-length], values[length:])
        length *= 2
    return np.minimum(values[:n], values[count - length : count - length + n])
