"""Words and word shingles of whole Arrow batches as 64-bit hashes, computed with numpy on UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D, A-Z lowered. A word's hash is a polynomial over a table of
random byte codes; powers are taken along the whole slice and divided out at the word's start, so that all words of a
slice cost one cumulative sum. Everything wraps modulo 2**64. Different words or shingles collide with a chance of about
2**-64 a pair; sets compared with one another hold some thousands of members, so collisions inside a comparison are negligible.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SEPARATORS = (0x20, *range(0x09, 0x0E))
_IS_SEPARATOR = np.zeros(256, dtype=bool)
_IS_SEPARATOR[list(SEPARATORS)] = True

#: White space and ASCII punctuation.
PUNCTUATION = _IS_SEPARATOR.copy()
PUNCTUATION[[b for b in range(0x21, 0x7F) if not chr(b).isalnum()]] = True

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SLICE_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit of the input (the finaliser of splitmix64)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_EXACT_CODES = mix(np.arange(1, 257, dtype=np.uint64) * _MULTIPLIER)
_CODES = _EXACT_CODES.copy()
_CODES[65:91] = _CODES[97:123]
_POWERS = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse; kept, and doubled when a longer slice comes."""
    if len(_POWERS["up"]) < n:
        size = max(n, min((1 << (n - 2).bit_length()) + 1, _SLICE_BYTES + 1))
        for name, base in (("up", _MULTIPLIER), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def text_slices(column: pa.Array, limit: int = _SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut a string column into runs of rows of about ``limit`` bytes: (first row, bytes, row offsets).

    A row is never cut, so a longer text makes a slice of its own. Null texts count as empty.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None else np.zeros(0, dtype=np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(
    data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _IS_SEPARATOR
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of all words of a slice and the row each is in.

    ``separators`` marks the bytes that part words.
    """
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = ~separators[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(len(data), dtype=bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(len(data), dtype=bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, codes: np.ndarray | None = None
) -> np.ndarray:
    """Hash of each byte span (A-Z lowered unless other codes are given); spans must not be negative."""
    codes = _CODES if codes is None else codes
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(codes[data] * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def span_hashes_exact(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As ``span_hashes``, case kept."""
    return span_hashes(data, starts, ends, _EXACT_CODES)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive hashes, crossing rows too; the caller drops those."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(n, np.uint64(size), dtype=np.uint64)
    for j in range(size):
        out = out * _STEP + hashes[j : j + n]
    return mix(out)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all word shingles of a slice, in text order.

    A row with 1 to size - 1 words has one shingle, its whole sequence; a row without words has none.
    """
    starts, ends, rows = words(data, offsets)
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    hashes = span_hashes(data, starts, ends)
    n = max(0, len(rows) - size + 1)
    whole = rows[:n] == rows[size - 1 :] if n else np.zeros(0, dtype=bool)
    at, out = rows[:n][whole], windows(hashes, size)[whole]
    counts = np.bincount(rows, minlength=len(offsets) - 1)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        extra = [windows(hashes[first[r] : first[r] + counts[r]], int(counts[r]))[0] for r in short]
        at, out = np.concatenate([at, short]), np.concatenate([out, np.array(extra, dtype=np.uint64)])
        order = np.argsort(at, kind="stable")
        at, out = at[order], out[order]
    return at, out


def distinct_by_row(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each row, rows in order and hashes ascending inside a row. Rows must be ascending."""
    if not len(rows):
        return rows, hashes
    hashes = hashes.copy()
    edges = np.concatenate([[0], np.flatnonzero(np.diff(rows)) + 1, [len(rows)]]).tolist()
    for first, last in zip(edges[:-1], edges[1:]):
        hashes[first:last].sort()
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[new], hashes[new]


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each of n rows, modulo 2**64; rows must be ascending."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    edges = np.searchsorted(rows, np.arange(n + 1))
    return sums[edges[1:]] - sums[edges[:-1]]
