"""Runs of repeated words: maximal stretches of words that are repeated with a period at least ``least_exponent`` times.

A run is a stretch of words i..j with smallest period q (words q apart are equal), at least ``max(least_words, least_exponent * q)``
words long, which no neighbouring word extends with period q. All of them are found in every whole text:

1. *Separators.* A run holds each of its words at least ``least_exponent`` times, and so does the word that would extend it. A word that stands
   fewer times between two separators can therefore be in no run and extend none: it is a separator itself. This is repeated until nothing
   changes; each stretch of separators then stands as one symbol of its own, unlike all others. What is left is the reduced document.
2. *Suffix trees.* Ukkonen's algorithm builds the tree of the reduced document and of its reversal. An Euler tour with a
   sparse table of depths gives the lowest common ancestor of two leaves in constant time, and with it the longest
   common extension of two places to the right and to the left; numpy answers all of a document's extensions at once.
3. *Lyndon roots.* Every run begins some root that is the longest Lyndon word at its place, in the order of symbols or in its reverse (Bannai
   et al., "The runs theorem", 2017). The longest Lyndon word at i ends before the next smaller suffix (next greater, in the reverse
   order), read off the tree's order of leaves by a stack. Each such word is a candidate, extended both ways by its own length.

Work and memory are in proportion to a document's words (times a logarithm for the sparse tables); documents are rows and independent.

Null and empty texts have no words, no runs and the hash of the empty string; rows with equal ids are documents of their own;
an empty table gives no rows; other columns are ignored. A null id is scrambled as the empty string by ``op13``'s rule.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST_WORDS, LEAST_EXPONENT = 6, 4


def suffix_tree(s: list[int]) -> tuple[list[dict[int, int]], list[int], list[int]]:
    """Ukkonen's tree of s, whose last symbol stands nowhere else: (children by first symbol, edge starts, edge ends).

    Node 0 is the root; the edge into node v is s[starts[v]:ends[v]]. Leaves have no children and end with s.
    """
    n = len(s)
    children: list[dict[int, int]] = [{}]
    starts, ends, links = [0], [0], [0]
    node, edge, length, rest = 0, 0, 0, 0
    for i, symbol in enumerate(s):
        rest += 1
        waiting = 0  # the inner node made last, whose link is not known yet
        while rest:
            if not length:
                edge = i
            down = children[node].get(s[edge])
            if down is None:
                children[node][s[edge]] = len(starts)
                children.append({})
                starts.append(i)
                ends.append(n)
                links.append(0)
                if waiting:
                    links[waiting] = node
                    waiting = 0
            else:
                size = min(ends[down], i + 1) - starts[down]
                if length >= size:
                    edge += size
                    length -= size
                    node = down
                    continue
                at = starts[down] + length
                if s[at] == symbol:
                    length += 1
                    if waiting:
                        links[waiting] = node
                    break
                split, leaf = len(starts), len(starts) + 1
                starts += [starts[down], i]
                ends += [at, n]
                links += [0, 0]
                children += [{s[at]: down, symbol: leaf}, {}]
                children[node][s[edge]] = split
                starts[down] = at
                if waiting:
                    links[waiting] = split
                waiting = split
            rest -= 1
            if node == 0 and length:
                length -= 1
                edge = i - rest + 1
            elif node:
                node = links[node]
    return children, starts, ends


class Extensions:
    """Longest common extensions of a sequence, and the order of its suffixes, from its suffix tree."""

    def __init__(self, s: list[int]):
        """s ends with a symbol that stands nowhere else."""
        n = len(s)
        children, starts, ends = suffix_tree(s)
        order, tour, first = [], [], [0] * n
        stack = [(0, 0)]
        while stack:
            v, depth = stack.pop()
            if v < 0:  # back in node ~v from one of its children
                tour.append(depth)
                continue
            depth += ends[v] - starts[v]
            below = children[v]
            if below or not v:
                tour.append(depth)
                for symbol in sorted(below, reverse=True):
                    stack.append((~v, depth))
                    stack.append((below[symbol], depth))
            else:
                suffix = n - depth
                first[suffix] = len(tour)
                order.append(suffix)
                tour.append(depth)
        self.rank = np.empty(n, dtype=np.int64)
        self.rank[order] = np.arange(n)
        self._first = np.array(first, dtype=np.int64)
        # the least depth of each stretch of 2**k steps of the tour; the least one between two leaves is their ancestor's
        self._least = [np.array(tour, dtype=np.int32)]
        while 2 << (len(self._least) - 1) <= len(tour):
            half = 1 << (len(self._least) - 1)
            self._least.append(np.minimum(self._least[-1][:-half], self._least[-1][half:]))

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes at i and j, which differ."""
        a, b = self._first[i], self._first[j]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(b - a + 1)[1] - 1
        out = np.empty(len(a), dtype=np.int64)
        for k in np.unique(level):
            on = level == k
            least = self._least[k]
            out[on] = np.minimum(least[a[on]], least[b[on] - (1 << int(k)) + 1])
        return out


def next_smaller(values: list[int]) -> list[int]:
    """Place of the next smaller value of each value, the length where there is none."""
    n = len(values)
    out, stack = [n] * n, []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            out[stack.pop()] = i
        stack.append(i)
    return out


def maximal_runs(s: list[int], least_words: int, least_exponent: int) -> np.ndarray:
    """(start, length, period) of all runs of s, by start and period."""
    n = len(s)
    last = max(s, default=0) + 1
    ahead = Extensions([*s, last])
    back = Extensions([*s[::-1], last])
    rank = ahead.rank.tolist()
    begins, ends = [], []
    for keys in (rank, [-r for r in rank]):
        ends.append(np.array(next_smaller(keys)[:n], dtype=np.int64))
        begins.append(np.arange(n))
    i, j = np.concatenate(begins), np.concatenate(ends)
    i, j = i[j < n], j[j < n]
    period = j - i
    right = ahead.common(i, j)
    left = np.zeros(len(i), dtype=np.int64)
    inner = i > 0
    # the words before place x are the reversal from n - x on
    left[inner] = back.common(n - i[inner], n - j[inner])
    start, length = i - left, left + period + right
    long_enough = length >= np.maximum(least_words, least_exponent * period)
    found = np.unique(np.stack([start, period, length], axis=1)[long_enough], axis=0)
    return found[:, [0, 2, 1]]


def reduced(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, places): the words that may be in a run, with one symbol of its own for each stretch of separators.

    ``words`` are small numbers from 0 on. A separator's place is that of its first word.
    """
    n = len(words)
    kept = np.bincount(words)[words] >= least if n else np.zeros(0, dtype=bool)
    while True:
        at = np.flatnonzero(kept)
        if not len(at):
            return np.zeros(0, dtype=np.int64), at
        stretch = np.cumsum(~kept)[at]
        _, inverse, counts = np.unique(stretch * (int(words.max()) + 1) + words[at], return_inverse=True, return_counts=True)
        rare = counts[inverse] < least
        if not rare.any():
            break
        kept[at[rare]] = False
    lone = ~kept
    lone[1:] &= kept[:-1]  # the first separator of each stretch stands for it
    places = np.flatnonzero(kept | lone)
    symbols = words[places].astype(np.int64)
    marks = lone[places]
    symbols[marks] = int(words.max()) + 1 + np.arange(int(marks.sum()))
    return symbols, places


def text_runs(words: list[bytes], least_words: int = LEAST_WORDS, least_exponent: int = LEAST_EXPONENT) -> np.ndarray:
    """(start, length, period) of all runs of a list of words, by start and period. ``least_exponent`` is 2 or more."""
    numbers: dict[bytes, int] = {}
    symbols, places = reduced(np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64), least_exponent)
    if not len(symbols):
        return np.zeros((0, 3), dtype=np.int64)
    runs = maximal_runs(symbols.tolist(), least_words, least_exponent)
    runs[:, 0] = places[runs[:, 0]]  # a run holds no separators, so its words are neighbours in the text too
    return runs


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those that some run contains after its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def find_runs(
    docs: DataFrame,
    prepare: Callable[[object, list[bytes]], list[bytes]] | None = None,
    least_words: int = LEAST_WORDS,
    least_exponent: int = LEAST_EXPONENT,
    texts: bool = True,
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_runs, the run of the greatest exact length / period (ties: smallest start, then period; start, length,
    period, exponent_milli; null without runs), runs_sha256 and collapsed_sha256, and with ``texts`` runs (array of start,
    length, period, by start and period) and collapsed (kept words joined by one space).

    Words are runs of bytes other than 0x20 and 0x09-0x0D. ``prepare(doc_id, words)`` may change them first.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    numbers = ["n_runs", "start", "length", "period", "exponent_milli"]
    hashes = ["runs_sha256", "collapsed_sha256"]
    run_type = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, all_runs, all_texts = [], [], []
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                words = (text.as_py() or "").encode().split()
                if prepare is not None:
                    words = prepare(doc_id.as_py(), words)
                runs = text_runs(words, least_words, least_exponent)
                listed = runs.tolist()
                best = None
                for start, length, period in listed:  # in order of start and period, so only a greater one replaces
                    if best is None or length * best[2] > best[1] * period:
                        best = (start, length, period)
                best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                kept = b" ".join(collapsed(words, runs))
                told = "".join(f"{start},{length},{period}\n" for start, length, period in listed)
                rows.append((
                    len(listed), *best, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
                if texts:
                    all_runs.append([dict(zip(("start", "length", "period"), r)) for r in listed])
                    all_texts.append(kept.decode())
            columns = [batch.column("doc_id")]
            columns += [pa.array([r[i] for r in rows], pa.int64() if i < 5 else pa.string()) for i in range(7)]
            if texts:
                columns += [pa.array(all_runs, pa.list_(run_type)), pa.array(all_texts, pa.string())]
            names = ["doc_id", *numbers, *hashes, *(["runs", "collapsed"] if texts else [])]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, {', '.join(f'{n} long' for n in numbers)}, {', '.join(f'{n} string' for n in hashes)}"
    if texts:
        schema += ", runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(search, schema)


def repeat_tail(doc_id: object, words: list[bytes]) -> list[bytes]:
    """Every tenth document, by the checksum of its id, with its tail made periodic: from word a on, word a + (i - a) % p."""
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [*words[:a], *(words[a + (i - a) % p] for i in range(a, n))]
