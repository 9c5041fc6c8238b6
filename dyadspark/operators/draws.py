"""Tickets of reads and the draw of the smallest ones, for rarefaction.

The ticket of read i of a row is the MD5 digest of the row's prefix, ``|`` and i. Digests are made for many reads at a time
with arrays, so a read costs a small part of a call of a hash function, and no row per read exists in Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Reads whose digests are made together, and reads sorted together unless one sample alone has more.
_DIGESTS, _SORTED = 1 << 14, 1 << 17
_SHIFTS = [s for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for s in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _blocks(state: list[np.ndarray], words: np.ndarray) -> list[np.ndarray]:
    """MD5 states after a block of 16 words each."""
    u = np.uint32
    a, b, c, d = (s.copy() for s in state)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, f)
            f &= b
            f ^= d
            g = i
        elif i < 32:
            np.bitwise_xor(b, c, f)
            f &= d
            f ^= c
            g = (5 * i + 1) % 16
        elif i < 48:
            np.bitwise_xor(b, c, f)
            f ^= d
            g = (3 * i + 5) % 16
        else:
            np.bitwise_not(d, f)
            f |= b
            f ^= c
            g = 7 * i % 16
        f += a
        f += u(_SINES[i])
        f += words[g]
        np.left_shift(f, u(_SHIFTS[i]), t)
        np.right_shift(f, u(32 - _SHIFTS[i]), f)
        f |= t
        f += b
        a, d, c, b, f = d, c, b, f, a
    return [s + x for s, x in zip(state, (a, b, c, d))]


def digests(texts: np.ndarray, lengths: np.ndarray, rows: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """MD5 of text ``rows`` followed by ``numbers`` in decimals, as two big-endian halves.

    ``texts``: a matrix of bytes, a text a row, ``lengths`` their bytes.
    """
    high, low = np.empty(len(rows), np.uint64), np.empty(len(rows), np.uint64)
    figures = np.ones(len(numbers), np.int64)
    top = 10
    while len(numbers) and top <= numbers.max():
        figures += numbers >= top
        top *= 10
    size = lengths[rows] + figures
    blocks = (size + 8) // 64 + 1
    for count in np.unique(blocks):
        places = np.flatnonzero(blocks == count)
        for first in range(0, len(places), _DIGESTS):
            at = places[first : first + _DIGESTS]
            text = np.zeros((len(at), 64 * count), np.uint8)
            width = min(texts.shape[1], 64 * count)
            text[:, :width] = texts[rows[at], :width]
            flat, base = text.reshape(-1), np.arange(len(at)) * (64 * count)
            left, end = numbers[at], base + size[at] - 1
            for k in range(int(figures[at].max())):
                on = figures[at] > k
                flat[end[on] - k] = left[on] % 10 + 48
                left = left // 10
            flat[end + 1] = 0x80
            words = np.ascontiguousarray(text.view("<u4").T)
            words[-2] = size[at] * 8 & 0xFFFFFFFF
            words[-1] = size[at] * 8 >> 32
            state = [np.full(len(at), s, np.uint32) for s in _START]
            for b in range(count):
                state = _blocks(state, words[16 * b : 16 * b + 16])
            a, b, c, d = (s.byteswap().astype(np.uint64) for s in state)
            high[at], low[at] = a << np.uint64(32) | b, c << np.uint64(32) | d
    return high, low


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Strings as a matrix of bytes and their lengths."""
    texts = [s.encode() for s in column.to_pylist()]
    lengths = np.array([len(s) for s in texts], np.int64)
    width = max(int(lengths.max(initial=0)), 1)
    return np.frombuffer(b"".join(s.ljust(width, b"\0") for s in texts), np.uint8).reshape(len(texts), width), lengths


def _tickets(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, and the two halves of the ticket, of each read of rows ``prefix, first, last``."""
    first, last = rows.column("first").to_numpy(), rows.column("last").to_numpy()
    counts = np.maximum(last - first + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    number = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts) + first[row]
    return (row, *digests(*_texts(rows.column("prefix")), row, number))


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str], reads: Callable) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole groups, together with the group's number of each row; rows come sorted by ``keys``, without them each is a group.

    Groups are handed on together until ``reads(rows)`` sums up to about ``_SORTED``.
    """
    held = None

    def starts(rows: pa.Table) -> np.ndarray:
        new = np.full(rows.num_rows, not keys)
        for key in keys:
            values = rows.column(key).combine_chunks()
            new[1:] |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False)
        return new

    def cut(rows: pa.Table, new: np.ndarray) -> Iterator[tuple[pa.Table, np.ndarray]]:
        first = np.append(np.flatnonzero(new | (np.arange(len(new)) == 0)), len(new))
        sums = np.add.reduceat(reads(rows), first[:-1])
        g = 0
        while g < len(sums):
            end, total = g + 1, sums[g]
            while end < len(sums) and total + sums[end] <= _SORTED:
                total += sums[end]
                end += 1
            part = slice(first[g], first[end])
            yield rows.slice(part.start, part.stop - part.start), np.cumsum(new[part]) - int(new[part.start])
            g = end

    for batch in batches:
        if batch.num_rows:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            new = starts(held)
            end = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if end:
                yield from cut(held.slice(0, end), new[:end])
                held = held.slice(end)
    if held is not None:
        yield from cut(held, starts(held))


def least(group: np.ndarray, high: np.ndarray, low: np.ndarray, depth: int) -> np.ndarray:
    """Which reads are among the ``depth`` smallest tickets of their group; groups are numbered upwards, in order."""
    sizes = np.bincount(group)
    bits = max(int(len(sizes) - 1).bit_length(), 1)
    mixed = group.astype(np.uint64) << np.uint64(64 - bits) | high >> np.uint64(bits)
    starts = np.cumsum(sizes) - sizes
    bound = np.sort(mixed)[starts + np.minimum(sizes, depth) - 1]
    kept = mixed <= bound[group]
    for g in np.flatnonzero(np.bincount(group[kept], minlength=len(sizes)) > depth):  # equal in these bits: by the whole ticket
        own = slice(starts[g], starts[g] + sizes[g])
        kept[own] = False
        kept[np.lexsort((low[own], high[own]))[:depth] + starts[g]] = True
    return kept


def _counted(rows: pa.Table, row: np.ndarray, shape: pa.Schema) -> list[pa.RecordBatch]:
    """Number of drawn reads (``row``: the row of each) per sample and taxon."""
    n, names = np.bincount(row, minlength=rows.num_rows), ["sample_id", "taxon_id"]
    out = rows.select(names).filter(pa.array(n > 0)).append_column("n", pa.array(n[n > 0]))
    out = out.group_by(names, use_threads=False).aggregate([("n", "sum")]).select([*names, "n_sum"])  # a taxon may have several rows
    return out.rename_columns([*names, "n"]).cast(shape).combine_chunks().to_batches()


def draw(depth: int, shape: pa.Schema) -> Callable:
    """Task that draws ``depth`` reads of each sample whose rows (``first`` to ``last`` of a taxon's reads) it has whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in groups_of(batches, ["sample_id"], lambda t: np.maximum(t.column("last").to_numpy(), 0)):
            n = rows.column("last").to_numpy()
            enough = np.minimum(np.bincount(group, weights=n), np.bincount(group, weights=np.maximum(n, 0))) >= depth
            if not enough.any():
                continue
            rows = rows.filter(pa.array(enough[group]))
            group = np.unique(group[enough[group]], return_inverse=True)[1]
            row, high, low = _tickets(rows)
            yield from _counted(rows, row[least(group[row], high, low, depth)], shape)

    return run


def candidates(depth: int, shape: pa.Schema) -> Callable:
    """Task that hands on the reads of large samples whose tickets lie below a bound that about ``depth`` + 30 deviations pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _ in groups_of(batches, [], lambda t: t.column("last").to_numpy() - t.column("first").to_numpy() + 1):
            row, high, low = _tickets(rows)
            share = np.minimum((depth + 30 * math.sqrt(depth) + 1000) / rows.column("total").to_numpy(), 1.0)
            on = high.astype(float) <= share[row] * 2.0**64
            taken = rows.select(["sample_id", "taxon_id"]).take(pa.array(row[on]))
            halves = [pa.array((half[on] ^ np.uint64(1 << 63)).view(np.int64)) for half in (high, low)]  # in the order of signed numbers
            yield from taken.append_column("high", halves[0]).append_column("low", halves[1]).cast(shape).combine_chunks().to_batches()

    return run


def draw_candidates(depth: int, shape: pa.Schema) -> Callable:
    """Task that draws ``depth`` of the candidates of each sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in groups_of(batches, ["sample_id"], lambda t: np.ones(t.num_rows, np.int64)):
            if np.bincount(group).min() < depth:
                raise RuntimeError("a sample has fewer candidates than reads to draw: its counts repeat the same taxa many times")
            high, low = (rows.column(c).to_numpy().view(np.uint64) ^ np.uint64(1 << 63) for c in ("high", "low"))
            kept = np.flatnonzero(least(group, high, low, depth))
            yield from _counted(rows, kept, shape)

    return run
