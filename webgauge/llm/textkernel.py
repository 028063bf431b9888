"""Vectorised text kernels over Arrow string buffers.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``.  Because those separators are
single bytes in UTF-8, runs can be found on the raw bytes.  Words are identified
by a 64-bit hash of their bytes (A-Z folded to a-z on request): a polynomial
prefix sum modulo 2**64, finished by an avalanche step.  Two different words
share a hash with probability about 2**-64 for each pair.

Everything here is plain numpy over one chunk of at most ``CHUNK`` bytes at a
time (or one word, where a single word is longer), so memory is bounded by the
chunk and not by the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21
U64 = np.uint64

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
IS_EDGE = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising avalanche of a 64-bit hash (the public MurmurHash3 finaliser)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
_FOLDED_VALUES = _BYTE_VALUES[LOWER]
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, CHUNK // 4 + 4096 if n <= CHUNK // 4 + 4096 else CHUNK + 4096)
        tables = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            tables.append(np.multiply.accumulate(steps))
        _powers = (tables[0], tables[1])
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the int64 offsets of a string or binary Arrow array; null reads as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(ends, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Byte ranges of about CHUNK bytes that end between words or between texts."""
    at, end = 0, len(data)
    while at < end:
        stop = min(at + CHUNK, end)
        if stop < end:
            k = int(np.searchsorted(offsets, stop, side="right")) - 1
            if offsets[k] > at and offsets[k] != stop and offsets[k + 1] - offsets[k] <= CHUNK:
                stop = int(offsets[k])
            elif offsets[k] != stop:  # inside a long text: on to the end of the word
                limit = int(offsets[k + 1])
                while stop < limit:
                    part = np.flatnonzero(~IS_WORD[data[stop : min(stop + 65536, limit)]])
                    if len(part):
                        stop += int(part[0])
                        break
                    stop = min(stop + 65536, limit)
        yield at, stop
        at = stop


def word_bounds(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in data[lo:hi]; texts end words."""
    part = IS_WORD[data[lo:hi]]
    first = part.copy()
    first[1:] &= ~part[:-1]
    last = part.copy()
    last[:-1] &= ~part[1:]
    cuts = offsets[np.searchsorted(offsets, lo, side="right") : np.searchsorted(offsets, hi, side="left")] - lo
    if len(cuts):
        first[cuts] = part[cuts]
        last[cuts - 1] = part[cuts - 1]
    return np.flatnonzero(first) + lo, np.flatnonzero(last) + lo + 1


def words(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text the offset of its first word (n + 1 offsets)."""
    hashes, _, _, at = _hashed(column, _FOLDED_VALUES if fold else _BYTE_VALUES, False)
    return hashes, at


def cores(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Folded hashes of all words without the ASCII punctuation at their ends, the byte ranges
    of these cores, and the offsets as in ``words``; a word of punctuation alone is hashed
    whole and has an empty range."""
    return _hashed(column, _FOLDED_VALUES, True)


def _hashed(column: pa.Array, values: np.ndarray, trim: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, offsets = buffers(column)
    hashes, begins, stops, places = [], [], [], []
    for lo, hi in spans(data, offsets):
        starts, ends = word_bounds(data, offsets, lo, hi)
        if not len(starts):
            continue
        places.append(starts)
        if trim:
            inner = np.flatnonzero(~IS_EDGE[data[lo:hi]]) + lo
            first, last = np.searchsorted(inner, starts), np.searchsorted(inner, ends)
            some = first < last
            inner = np.append(inner, 0)
            a, b = np.where(some, inner[first], starts), np.where(some, inner[last - 1] + 1, starts)
            begins.append(a)
            stops.append(b)
            starts, ends = np.where(some, a, starts), np.where(some, b, ends)
        power, inverse = _power_tables(hi - lo + 1)
        total = np.empty(hi - lo + 1, dtype=U64)
        total[0] = 0
        np.cumsum(values[data[lo:hi]] * power[: hi - lo], out=total[1:])
        hashes.append(mix((total[ends - lo] - total[starts - lo]) * inverse[starts - lo] + (ends - starts).astype(U64)))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    at = np.searchsorted(join(places, np.int64), offsets, side="left").astype(np.int64)
    return join(hashes, U64), join(begins, np.int64), join(stops, np.int64), at


_SHINGLE = [U64(x | 1) for x in (0x8CB92BA72F3D8DD7, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words, ignoring text ends."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n] * _SHINGLE[0]
    for k in range(1, width):
        out = mix(out) if k == 8 else out
        out += hashes[k : k + n] * _SHINGLE[k % 8]
    return mix(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    if len(x) < 2:
        return x
    x = np.sort(x)
    keep = np.empty(len(x), dtype=bool)
    keep[0] = True
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def shingle_sets(column: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text its sorted distinct ``width``-word shingles.

    A text of fewer words gives its whole word sequence as one shingle; a text
    without words gives the empty set.
    """
    hashes, at = words(column)
    windows = window_hashes(hashes, width)
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= width:
            yield distinct(windows[lo : hi - width + 1])
        elif hi > lo:
            whole = window_hashes(hashes[lo:hi], hi - lo)
            yield mix(whole + U64(hi - lo))
        else:
            yield np.zeros(0, U64)


def tally(x: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values with the number, or the summed weights, of each."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    if weights is None:
        x = np.sort(x)
    else:
        order = np.argsort(x, kind="stable")
        x, weights = x[order], weights[order]
    first = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
    if weights is None:
        return x[first], np.diff(np.append(first, len(x)))
    return x[first], np.add.reduceat(weights, first)


def find(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each x in a sorted table, and whether it is there."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.searchsorted(table, x)
    at[at == len(table)] = 0
    return at, table[at] == x
