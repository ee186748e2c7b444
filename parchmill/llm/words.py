"""Words and word shingles of Arrow text columns, hashed without a Python loop over words.

A word is a maximal run of bytes other than space and ``\\t \\n \\v \\f \\r``; in UTF-8
those bytes occur in no other character.  A word's hash comes from a prefix
polynomial hash modulo 2**64 (the span's difference times the inverse power) and a
finalising mix; ASCII capitals hash as small letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text hashed at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20
U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_codes = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_codes[65:91] = _codes[97:123]
CODES = _codes
_powers: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i up to n, modulo 2**64."""
    while len(_powers[0]) <= n:
        for k, base in enumerate((BASE, INVERSE)):
            old = _powers[k]
            _powers[k] = np.concatenate([old, old * U(pow(base, len(old), 1 << 64))])
    return _powers[0], _powers[1]


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets from 0) of consecutive rows; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        end = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        end = min(max(end, first + 1), len(column))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


@dataclass
class Words:
    """``bounds[d]:bounds[d + 1]`` are the words of row d; starts and ends are byte positions."""

    bounds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray


def long_word(data: np.ndarray) -> int:
    """The polynomial hash of a word of any length, a chunk at a time."""
    power, total = powers(CHUNK_BYTES)[0], 0
    for a in range(0, len(data), CHUNK_BYTES):
        piece = data[a : a + CHUNK_BYTES]
        total += int((CODES[piece] * power[: len(piece)]).sum()) * pow(BASE, a, 1 << 64)
    return total % (1 << 64)


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(len(offsets), np.int64), none, none, np.zeros(0, U))
    space = IS_SPACE[data]
    begin, stop = ~space, ~space
    begin[1:] &= space[:-1]
    stop[:-1] &= space[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begin[inner] = ~space[inner]
    stop[inner - 1] = ~space[inner - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    hashes = np.zeros(len(starts), U)
    first = 0
    while first < len(starts):
        # as many words as begin and end within a chunk, or one longer word
        last = max(int(np.searchsorted(ends, starts[first] + CHUNK_BYTES, "right")), first + 1)
        a, b = int(starts[first]), int(ends[last - 1])
        if b - a > CHUNK_BYTES:
            hashes[first] = long_word(data[a:b])
        else:
            power, inverse = powers(b - a)
            prefix = np.zeros(b - a + 1, U)
            np.cumsum(CODES[data[a:b]] * power[: b - a], out=prefix[1:])
            own = starts[first:last] - a
            hashes[first:last] = (prefix[ends[first:last] - a] - prefix[own]) * inverse[own]
        first = last
    hashes = mix(hashes)
    return Words(np.searchsorted(starts, offsets), starts, ends, hashes)


def shingle_sets(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each row, end to end, and their bounds.

    A row with fewer words than ``width`` has its whole sequence as one shingle; one
    without words has none.
    """
    bounds, h = found.bounds, found.hashes
    counts = np.diff(bounds)
    if not len(h):
        return np.zeros(0, U), np.zeros(len(bounds), np.int64)
    padded = np.concatenate([h, np.zeros(width - 1, U)])
    all_windows = np.full(len(h), width, U)
    for j in range(width):
        all_windows = all_windows * U(0xA0761D6478BD642F) + padded[j : j + len(h)]
    place = np.arange(len(h)) - np.repeat(bounds[:-1], counts)
    valid = place <= np.repeat(counts, counts) - width
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        a, b, value = bounds[d], bounds[d + 1], int(counts[d])
        for word in h[a:b].tolist():
            value = (value * 0xA0761D6478BD642F + word) & 0xFFFFFFFFFFFFFFFF
        all_windows[a], valid[a] = value, True
    shingles = mix(all_windows[valid])
    many = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    edges = np.concatenate([[0], np.cumsum(many)])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        shingles[a:b].sort()
    new = np.ones(len(shingles), bool)
    new[1:] = shingles[1:] != shingles[:-1]
    new[edges[:-1][many > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return shingles[new], kept[edges]


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values[bounds[d]:bounds[d + 1]]``, 0 for empty rows (wraps for unsigned values)."""
    total = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
