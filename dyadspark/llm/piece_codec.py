"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces and their log scores are read from a model file. A text is prefixed with a space, spaces become the marker
U+2581, and the segmentation with the largest sum of scores is taken; of equal sums the one whose last piece begins
first. A character that no piece covers alone may be taken as unknown, at ``UNKNOWN_PENALTY`` below the smallest score, and is then
spelled in byte pieces (without byte pieces: one unknown id). Decoding joins the pieces, reads byte pieces as UTF-8 (invalid
bytes as U+FFFD), turns markers into spaces and drops the leading one.

All positions of a slice walk the trie in step, and all segments of a slice go through Viterbi in step, so the work is
numpy's. A segment runs from a space to the next word's space; since no piece goes on from another character into a
marker, segments are independent, and each distinct one is solved once while a worker's bounded cache holds it.

Null and empty texts have no pieces and decode to the empty text. A marker in a text is read as a space, as the library does.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from dyadspark.llm.hashing import span_hashes_exact, text_slices

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
#: Segments whose ids a worker keeps.
CACHED = 500_000
#: Bytes of rows coded at once, and of new segments solved at once; a longer row or segment is one of its own.
_SLICE, _SOLVED = 1 << 18, 1 << 16
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, kind) of a model file, whose format is a protocol buffer: field 1 of the model is a piece, with the
    piece's text, score and kind in its fields 1, 2 and 3."""
    with open(path, "rb") as f:
        data = f.read()

    def fields(buf: bytes) -> Iterator[tuple[int, object]]:
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                b = buf[at]
                at += 1
                value |= (b & 0x7F) << shift
                shift += 7
                if b < 0x80:
                    return value

        while at < len(buf):
            tag = number()
            wire = tag & 7
            if wire == 0:
                yield tag >> 3, number()
            elif wire == 2:
                size = number()
                yield tag >> 3, buf[at : at + size]
                at += size
            else:
                size = {1: 8, 5: 4}[wire]
                yield tag >> 3, buf[at : at + size]
                at += size

    out = []
    for field, value in fields(data):
        if field == 1:
            piece, score, kind = "", 0.0, NORMAL
            for f, v in fields(value):
                if f == 1:
                    piece = v.decode("utf-8")
                elif f == 2:
                    score = struct.unpack("<f", v)[0]
                elif f == 3:
                    kind = v
            out.append((piece, score, kind))
    return out


@dataclass
class Trie:
    """Double-array trie over bytes: the child of state s by byte b is base[s] + b, if check there is s."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray


def build_trie(keys: list[bytes]) -> Trie:
    """keys: distinct and not empty; their place in the list is their value."""
    root: dict = {}
    for i, key in enumerate(keys):
        node = root
        for b in key:
            node = node.setdefault(b, {})
        node[-1] = i
    size = 1 << 16
    base, check, value = (np.full(size, v, dtype=np.int32) for v in (0, -1, -1))
    check[0] = 0
    taken = np.zeros(size, dtype=bool)
    taken[0] = True
    todo, low = [(0, root)], 1
    while todo:
        state, node = todo.pop()
        value[state] = node.get(-1, -1)
        children = sorted(b for b in node if b >= 0)
        if not children:
            continue
        offsets, at, begin = np.array(children), low, 0
        while not begin:
            if at + 1024 > size:
                base, check, value = (
                    np.concatenate([a, np.full(size, v, dtype=np.int32)]) for a, v in ((base, 0), (check, -1), (value, -1)))
                taken = np.concatenate([taken, np.zeros(size, dtype=bool)])
                size *= 2
            # the first of the next 512 places where no child is taken
            begins = np.arange(at, at + 512) - children[0]
            begins = begins[begins > 0]
            fits = np.flatnonzero(~taken[begins[:, None] + offsets].any(axis=1))
            if len(fits):
                begin = int(begins[fits[0]])
            at += 512
        base[state] = begin
        taken[begin + offsets] = True
        check[begin + offsets] = state
        todo += [(begin + b, node[b]) for b in children]
        while taken[low : low + 512].mean() > 0.95:
            low += 512
    last = int(np.flatnonzero(taken).max()) + 257
    return Trie(base[:last].copy(), check[:last].copy(), value[:last].copy())


class Codec:
    """Encodes and decodes with the pieces of one model."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        usable = [(i, p, s) for i, (p, s, kind) in enumerate(pieces) if kind in (NORMAL, USER) and p]
        keys = [p.replace(MARKER, " ").encode("utf-8") for _, p, _ in usable]
        if any(" " in k.decode("utf-8").lstrip(" ") for k in keys):
            raise ValueError("a piece goes on from another character into a marker")
        self.trie = build_trie(keys)
        self.ids = np.array([i for i, _, _ in usable], dtype=np.int32)
        self.scores = np.array([s for _, _, s in usable], dtype=np.float64)
        self.longest = max(map(len, keys))
        self.unknown_score = self.scores.min() - UNKNOWN_PENALTY
        self.unknown_id = next((i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN), 0)
        by_byte = {int(p[3:-1], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.byte_ids = np.array([by_byte[b] for b in range(256)], dtype=np.int32) if len(by_byte) == 256 else None
        self.is_byte = np.array([k == BYTE for _, _, k in pieces], dtype=bool)
        self._bytes = [
            bytes([int(p[3:-1], 16)]) if k == BYTE else b"" if k == CONTROL
            else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARKER, " ").encode("utf-8")
            for p, _, k in pieces
        ]
        self._forget()

    def _edges(self, data: np.ndarray, limit: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, key) of all pieces that begin at ``starts`` and end at or before ``limit``."""
        trie, found = self.trie, []
        at, state, ends = starts, np.zeros(len(starts), dtype=np.int32), limit
        depth = 0
        while len(at):
            inside = at + depth < ends
            at, state, ends = at[inside], state[inside], ends[inside]
            following = trie.base[state] + data[at + depth]
            ok = (trie.check[following] == state) & (trie.base[state] > 0)
            at, state, ends = at[ok], following[ok], ends[ok]
            depth += 1
            keys = trie.value[state]
            hit = keys >= 0
            if hit.any():
                found.append((at[hit], at[hit] + depth, keys[hit]))
        if not found:
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found))

    def _solve(self, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of segments that lie one after another in ``data``: (ids, number of ids of each segment)."""
        n, m = len(data), len(lengths)
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        limit = np.repeat(first + lengths, lengths)
        chars = np.flatnonzero((data & 0xC0) != 0x80)
        # bytes that go on a character and stand at a segment's start cannot occur in valid UTF-8
        char_end = np.empty(n + 1, dtype=np.int64)
        char_end[chars] = np.concatenate([chars[1:], [n]])
        start, end, key = self._edges(data, limit[chars], chars)
        score, kind = self.scores[key], key.astype(np.int64)
        alone = np.zeros(n + 1, dtype=bool)
        alone[start[end == char_end[start]]] = True
        lone = chars[~alone[chars]]
        start = np.concatenate([start, lone])
        end = np.concatenate([end, char_end[lone]])
        score = np.concatenate([score, np.full(len(lone), self.unknown_score)])
        kind = np.concatenate([kind, np.full(len(lone), -1)])
        # edges by their start's place in its segment: one step for each place, all segments at once
        place = start - np.repeat(first, lengths)[start]
        order = np.argsort(place, kind="stable")
        start, end, score, kind, place = (a[order] for a in (start, end, score, kind, place))
        # positions of best: one more than bytes for each segment, as a segment's end is not the next one's start
        shift = np.repeat(np.arange(m), lengths)[start]
        source, target = start + shift, end + shift
        best = np.full(n + m, -np.inf)
        best[first + np.arange(m)] = 0.0
        back = np.zeros(n + m, dtype=np.int64)
        steps = np.searchsorted(place, np.arange(int(lengths.max()) + 1)) if m else np.zeros(1, dtype=np.int64)
        for a, b in zip(steps[:-1].tolist(), steps[1:].tolist()):
            if a == b:
                continue
            total = best[source[a:b]] + score[a:b]
            t = target[a:b]
            better = total > best[t]
            t = t[better]
            best[t] = total[better]
            back[t] = np.arange(a, b)[better]
        # back from the segments' ends, all at once
        segment = np.arange(m)
        at, origin, path = first + lengths + segment, first + segment, []
        while len(at):
            edge = back[at]
            path.append((segment, edge))
            at = source[edge]
            more = at > origin
            at, origin, segment = at[more], origin[more], segment[more]
        if not path:
            return np.zeros(0, dtype=np.int32), np.zeros(m, dtype=np.int64)
        segments, edges = (np.concatenate(x) for x in zip(*path))
        order = np.lexsort((start[edges], segments))
        segments, edges = segments[order], edges[order]
        unknown = kind[edges] < 0
        size = np.ones(len(edges), dtype=np.int64)
        if self.byte_ids is not None:
            size[unknown] = (end - start)[edges[unknown]]
        ids = np.empty(int(size.sum()), dtype=np.int32)
        put = np.concatenate([[0], np.cumsum(size)[:-1]])
        ids[put[~unknown]] = self.ids[kind[edges[~unknown]]]
        if unknown.any():
            if self.byte_ids is None:
                ids[put[unknown]] = self.unknown_id
            else:
                to, source_byte = _ranges(put[unknown], size[unknown]), _ranges(start[edges[unknown]], size[unknown])
                ids[to] = self.byte_ids[data[source_byte]]
        return ids, np.bincount(segments, weights=size, minlength=m).astype(np.int64)

    def encode_slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, row offsets of ids) of rows of bytes, each already opened by its space."""
        if not len(data):
            return np.zeros(0, dtype=np.int32), np.zeros(len(offsets), dtype=np.int64)
        space = data == 0x20
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        ends = np.concatenate([starts[1:], [len(data)]])
        hashes, where, which = np.unique(
            span_hashes_exact(data, starts, ends), return_index=True, return_inverse=True)
        begin, counts = self._known(hashes, data, starts[where], (ends - starts)[where])
        begin, counts = begin[which], counts[which]
        after = np.concatenate([[0], np.cumsum(counts)])
        return self._ids[_ranges(begin, counts)], after[np.searchsorted(starts, offsets)]

    def _known(
        self, hashes: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each segment begin in the cache, and their number; segments not in it are solved first.

        The cache holds up to ``CACHED`` segments beside those of the present slice and begins anew when it is full.
        """
        if len(self._hashes) > CACHED:
            self._forget()
        at = np.minimum(np.searchsorted(self._hashes, hashes), max(len(self._hashes) - 1, 0))
        new = self._hashes[at] != hashes if len(self._hashes) else np.ones(len(hashes), dtype=bool)
        if new.any():
            ids, counts = self._solve_in_runs(data, starts[new], lengths[new])
            begin = len(self._ids) + np.concatenate([[0], np.cumsum(counts)[:-1]])
            self._ids = np.concatenate([self._ids, ids])
            known = np.concatenate([self._hashes, hashes[new]])
            order = np.argsort(known, kind="stable")
            self._hashes = known[order]
            self._begin = np.concatenate([self._begin, begin])[order]
            self._count = np.concatenate([self._count, counts])[order]
            at = np.searchsorted(self._hashes, hashes)
        return self._begin[at], self._count[at]

    def _solve_in_runs(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``_solve`` for the segments at these places, some at once: its arrays take hundreds of bytes for a byte of text."""
        after = np.cumsum(lengths)
        solved, first = [], 0
        while first < len(lengths):
            done = int(after[first - 1]) if first else 0
            last = max(int(np.searchsorted(after, done + _SOLVED, side="right")), first + 1)
            run = slice(first, last)
            solved.append(self._solve(data[_ranges(starts[run], lengths[run])], lengths[run]))
            first = last
        return tuple(np.concatenate(x) for x in zip(*solved))

    def _forget(self) -> None:
        self._hashes = np.zeros(0, dtype=np.uint64)
        self._begin = self._count = np.zeros(0, dtype=np.int64)
        self._ids = np.zeros(0, dtype=np.int32)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, row offsets) for runs of rows of a string column."""
        for first, _, rows in text_slices(texts, _SLICE):
            part = pc.fill_null(texts.slice(first, len(rows) - 1).cast(pa.large_string()), "")
            opened = pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), part, pa.scalar("", pa.large_string()))
            part = pc.replace_substring(pc.if_else(pc.equal(part, ""), part, opened), MARKER, " ")
            for at_part, data, offsets in text_slices(part):
                ids, at = self.encode_slice(data, offsets)
                yield first + at_part, ids, at

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self._bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges one after another."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return shift + np.arange(total)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_pieces, n_byte_pieces, decoded of every row; ``decoded`` is read back from the ids alone.

    The model's pieces are broadcast; their number does not grow with the data. Rows stay as they are, other columns are
    ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Codec(read_pieces(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in batches:
            for first, ids, at in codec.encode(batch.column("text")):
                rows = len(at) - 1
                is_byte = np.concatenate([[0], np.cumsum(codec.is_byte[ids])])
                decoded = [codec.decode(ids[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, rows),
                     pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids)), pa.array(np.diff(at)),
                     pa.array((is_byte[at[1:]] - is_byte[at[:-1]]).astype(np.int64)), pa.array(decoded, pa.string())],
                    names=["doc_id", "ids", "n_pieces", "n_byte_pieces", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, ids array<int>, n_pieces long, n_byte_pieces long, decoded string")
