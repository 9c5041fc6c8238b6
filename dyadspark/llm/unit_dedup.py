"""Substring dedup by hashes of lines, sentences and content-defined stretches.

A text is cut into units: a unit ends with its line, or with a word that ends in ``.``, ``!`` or ``?``, so that a passage set into the
middle of a line is found too. Units are normalised (A-Z lowered, white space collapsed) and hashed; digests are grouped over
all documents, and the occurrence with the smallest doc_id, in it the first, is kept. A later occurrence is removed if the run of
neighbouring repeated units it stands in has at least ``min_words`` words, so chance repeats of a word or two inside a line stay.
A whole line that an earlier line equals is removed whatever its length: lines of fewer words have a digest of their own.

Passages whose edges are no unit's edges are found by chains: words whose hash is a local minimum are anchors, wherever they
stand, and a chain goes from an anchor to the first one that gives it ``CHAIN`` words, across lines. All words of a chain that an
earlier document holds are removed, but where it reaches fewer than ``EDGE`` words into a sentence these stay. Anchors depend
on the words beside them alone, so of a passage only the few words before its first and after its last anchor stay. Chains inside one
document are not compared.

Only (digest, doc_id) pairs are shuffled, one for each distinct unit, short line and chain of a document; a digest's pairs are pre-aggregated
before the shuffle, so a line that a third of all documents share is no hot group.

Removed spans are reported in code points of the original text; the rest stays as it was. Null texts stay null and have no
units; a text of repeated units alone becomes empty, its row stays. Rows with equal doc_id rank alike: what is first in one of them is kept
in all. Null doc_ids rank last and among themselves keep everything. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from dyadspark.llm.hashing import mix, powers, span_hashes, text_slices, words

_DROPS, _REMOVED = "__unit_drops", "__unit_removed"
#: Words a chain has at least.
CHAIN = 25
#: Fewer words of a sentence than these stay when a chain reaches into it.
EDGE = 4
#: Tell the digests of lines and chains from those of units with the same words.
_LINE, _CHAIN = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
_SENTENCE_ENDS = np.frombuffer(b".!?", dtype=np.uint8)


class Units:
    """Units, whole lines and chains of a slice, and the digests a document is known by.

    ``row``, ``digest`` list what is compared: all units, then the lines of fewer than ``min_words`` words, then the chains.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, min_words: int):
        self.starts, self.ends, self.rows = starts, ends, rows = words(data, offsets)
        n = len(starts)
        none = np.zeros(0, dtype=np.int64)
        self.first = self.last = self.line_first = self.line_last = self.chain_first = self.chain_last = self.row = none
        self.digest = none.astype(np.uint64)
        if not n:
            return
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        line_ends = np.ones(n, dtype=bool)
        line_ends[:-1] = (rows[1:] != rows[:-1]) | (lines[starts[1:]] > lines[ends[:-1]])
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        hashes = span_hashes(data, starts, ends)
        np.cumsum(hashes * up[:-1], out=sums[1:])

        def spans(closes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            last = np.flatnonzero(closes)
            return np.concatenate([[0], last[:-1] + 1]), last

        def digests(first: np.ndarray, last: np.ndarray) -> np.ndarray:
            return mix((sums[last + 1] - sums[first]) * down[first] + (last - first + 1).astype(np.uint64))

        self.first, self.last = spans(line_ends | np.isin(data[ends - 1], _SENTENCE_ENDS))
        a, b = spans(line_ends)
        short = b - a + 1 < min_words
        self.line_first, self.line_last = a[short], b[short]
        # anchors: words whose hash neither neighbour's is below; the ends of a text have no neighbour
        anchor = np.ones(n, dtype=bool)
        if n > 1:
            within = rows[1:] == rows[:-1]
            anchor[1:] &= ~within | (hashes[1:] <= hashes[:-1])
            anchor[:-1] &= ~within | (hashes[:-1] <= hashes[1:])
        anchors = np.flatnonzero(anchor)
        to = np.searchsorted(anchors, anchors + CHAIN - 1)
        whole = to < len(anchors)
        a, b = anchors[whole], anchors[to[whole]]
        own = rows[a] == rows[b]
        self.chain_first, self.chain_last = a[own], b[own]
        self.digest = np.concatenate([
            digests(self.first, self.last), mix(digests(self.line_first, self.line_last) + _LINE),
            mix(digests(self.chain_first, self.chain_last) + _CHAIN)])
        self.row = rows[np.concatenate([self.first, self.line_first, self.chain_first])]


def _digests(docs: DataFrame, min_words: int) -> DataFrame:
    """(digest, doc_id), one row for each distinct unit, short line and chain of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for first, data, offsets in text_slices(batch.column("text")):
                u = Units(data, offsets, min_words)
                order = np.lexsort((u.digest, u.row))
                row, digest = u.row[order], u.digest[order]
                new = np.ones(len(row), dtype=bool)
                new[1:] = (row[1:] != row[:-1]) | (digest[1:] != digest[:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(digest[new].view(np.int64)), ids.take(pa.array(first + row[new]))], names=["digest", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"digest long, doc_id {kind}")


def repeated_units(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """doc_id and the digests of its units, short lines and chains whose kept occurrence is in an earlier document."""
    pairs = _digests(docs, min_words)
    first = pairs.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    later = pairs.join(first.where((F.col("n") > 1) & F.col("first_id").isNotNull()).drop("n"), "digest").where(
        F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first_id")))
    return later.groupBy("doc_id").agg(F.collect_set("digest").alias(_DROPS))


def _marks(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in one of the spans; ``last`` is inclusive."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, last + 1, -1)
    return np.cumsum(step[:-1]) > 0


def _stretches(marked: np.ndarray, rows: np.ndarray) -> list[tuple[int, int]]:
    """(first, after the last) of the longest stretches of marked words, none beyond its row."""
    edge = np.ones(len(marked) + 1, dtype=bool)
    edge[1:-1] = (marked[1:] != marked[:-1]) | (rows[1:] != rows[:-1])
    edges = np.flatnonzero(edge)
    own = marked[edges[:-1]] if len(marked) else np.zeros(0, dtype=bool)
    return list(zip(edges[:-1][own].tolist(), edges[1:][own].tolist()))


def _cut(data: np.ndarray, offsets: np.ndarray, drops: list, min_words: int) -> tuple[list[bytes], list[list]]:
    """Texts without the removed runs, and the removed spans in code points."""
    u = Units(data, offsets, min_words)
    flat = np.concatenate([*(np.asarray(d, dtype=np.int64) for d in drops), np.zeros(0, dtype=np.int64)]).view(np.uint64)
    of = np.repeat(np.arange(len(drops)), [len(d) for d in drops])
    # (row, digest) pairs are compared as one mixed number
    key = mix(u.digest + mix(u.row.astype(np.uint64) + np.uint64(1)))
    wanted = mix(flat + mix(of.astype(np.uint64) + np.uint64(1)))
    repeated = np.isin(key, wanted)
    units, n = len(u.first), len(u.starts)
    chains = units + len(u.line_first)
    # chains of one text overlap, so only those of earlier documents count
    again = np.ones(chains, dtype=bool)
    again[np.unique(key[:chains], return_index=True)[1]] = False
    repeated[:chains] |= again
    # runs of repeated units, whole lines, then chains, as marks on words
    gone = np.zeros(n, dtype=bool)
    if n:
        covered = _marks(u.first[repeated[:units]], u.last[repeated[:units]], n)
        for a, b in _stretches(covered, u.rows):
            gone[a:b] = b - a >= min_words
        gone |= _marks(u.line_first[repeated[units:chains]], u.line_last[repeated[units:chains]], n)
        inside = _marks(u.chain_first[repeated[chains:]], u.chain_last[repeated[chains:]], n)
        unit = np.repeat(np.arange(units), u.last - u.first + 1)
        for a, b in _stretches(inside, unit):
            gone[a:b] |= b - a >= EDGE or b - a == u.last[unit[a]] - u.first[unit[a]] + 1
    texts = [None] * (len(offsets) - 1)
    spans: list[list] = [[] for _ in texts]
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    cuts: list[list] = [[] for _ in texts]
    for a, b in _stretches(gone, u.rows):
        row = int(u.rows[a])
        stop = int(u.starts[b]) if b < n and u.rows[b] == row else int(offsets[row + 1])
        cuts[row].append((int(u.starts[a]), stop))
        base = chars[offsets[row]]
        spans[row].append({"start": int(chars[u.starts[a]] - base), "end": int(chars[stop] - base)})
    raw = data.tobytes()
    for row in range(len(texts)):
        at, parts = int(offsets[row]), []
        for start, stop in cuts[row]:
            parts.append(raw[at:start])
            at = stop
        parts.append(raw[at : int(offsets[row + 1])])
        texts[row] = b"".join(parts)
    return texts, spans


def dedup_units(docs: DataFrame, min_words: int = 10, spans_column: str | None = "removed") -> DataFrame:
    """``docs`` with repeated units cut from ``text``; ``spans_column`` gets the removed (start, end) spans of the original.

    A column ``n_chars`` of ``docs`` is set to the new length. ``spans_column`` None leaves the columns as they are.
    """
    if spans_column in docs.columns:
        raise ValueError(f"{spans_column} is a column of the documents")
    drops = repeated_units(docs, min_words).withColumnRenamed("doc_id", "__unit_doc")
    joined = docs.join(drops, F.col("doc_id").eqNullSafe(F.col("__unit_doc")), "left").drop("__unit_doc")
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            lists = [d or [] for d in batch.column(_DROPS).to_pylist()]
            texts, removed = [], []
            for first, data, offsets in text_slices(column):
                t, r = _cut(data, offsets, lists[first : first + len(offsets) - 1], min_words)
                texts += t
                removed += r
            new = pa.array([t.decode("utf-8") for t in texts], pa.string(), mask=np.asarray(column.is_null()))
            arrays = [new if n == "text" else c for n, c in zip(batch.schema.names, batch.columns) if n != _DROPS]
            names = [n for n in batch.schema.names if n != _DROPS]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(removed, span)], names=[*names, _REMOVED])

    out = T.StructType([
        *docs.schema.fields,
        T.StructField(_REMOVED, T.ArrayType(T.StructType([
            T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    result = joined.mapInArrow(run, out)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        result = result.withColumn("n_chars", F.when(
            F.size(_REMOVED) > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return result.drop(_REMOVED) if spans_column is None else result.withColumnRenamed(_REMOVED, spans_column)
