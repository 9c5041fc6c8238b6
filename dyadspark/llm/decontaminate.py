"""Benchmark decontamination: n-gram seeds and Smith-Waterman alignment.

Texts and test items are read as words (runs of bytes other than white space and ASCII punctuation, A-Z lowered). Every
``n``-word run of an item is a seed, however many documents hold it: edits can leave a spread-out test item with frequent runs alone,
and a score of 0.5 implies no number of shared runs above one (two matches to one edit reach it), so a pair may not be
ruled out by their count. Every seed found in a document names a
region of it; the item is aligned with each region (word by word, local alignment: ``MATCH``, ``MISMATCH``, ``GAP``), and the
score is the alignment's share of the best possible one, 1 for a whole exact copy. Edited and partial copies score less.
Pairs in which fewer of the item's words occur in the document than the least score needs are passed over, which is exact.

Documents' runs pass a bitmap of fixed size of the benchmark's runs before they are joined, so what is broadcast does not
grow with either table; the join afterwards is exact. Hot seeds are joined by Spark with its skew handling, and candidates are one
row a (document, item, region) before texts are moved.

Documents that are null or empty match nothing, nor do items without a word. An item of fewer than ``n`` words is seeded by its whole
sequence. Rows with equal doc_id, or equal item_id, are told apart by their text: a match is reported once for each
pair of ids, with the best score. Rows with a null id are matched and reported under null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from dyadspark.llm.hashing import PUNCTUATION, span_hashes, text_slices, windows, words
from dyadspark.session import materialise

MATCH, MISMATCH, GAP = 2, -1, -1
#: Regions are this many words apart.
STRIDE = 64
_BITS = 24


def _runs(data: np.ndarray, offsets: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, row, hash, place in the row, words of the row) of all word runs of the sizes given."""
    starts, ends, rows = words(data, offsets, PUNCTUATION)
    if not len(starts):
        return
    hashes = span_hashes(data, starts, ends)
    count = np.bincount(rows, minlength=len(offsets) - 1)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    for size in sizes:
        m = len(rows) - size + 1
        if m > 0:
            whole = rows[:m] == rows[size - 1 :]
            at = np.flatnonzero(whole)
            row = rows[:m][whole]
            yield size, row, windows(hashes, size)[whole], at - first[row], count[row]


def item_runs(items: DataFrame, n: int) -> DataFrame:
    """item_id, run, place, size of all items: their n-word runs, or their whole sequence if they are shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in text_slices(batch.column("text")):
                for size, row, hashes, place, length in _runs(data, offsets, list(range(1, n + 1))):
                    own = (length == size) if size < n else np.ones(len(row), dtype=bool)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("item_id").take(pa.array(first + row[own])), pa.array(hashes[own].view(np.int64)),
                         pa.array(place[own].astype(np.int32)), pa.array(np.full(own.sum(), size, dtype=np.int32))],
                        names=["item_id", "run", "place", "size"])

    kind = items.schema["item_id"].dataType.simpleString()
    return items.select("item_id", "text").mapInArrow(run, f"item_id {kind}, run long, place int, size int")


def bitmap(runs: DataFrame) -> np.ndarray:
    """Packed bits of the runs' leading ``_BITS`` bits; at most 2**_BITS numbers come to the driver, whatever the table's size."""
    bits = np.zeros(1 << _BITS, dtype=bool)
    slot = F.shiftrightunsigned("run", 64 - _BITS)
    for batch in runs.select(F.floor(slot / 512).cast("int").alias("block"), (slot % 512).cast("int").alias("bit")).groupBy(
            "block").agg(F.collect_set("bit").alias("bits")).toLocalIterator():
        bits[batch.block * 512 + np.array(batch.bits, dtype=np.int64)] = True
    return np.packbits(bits)


def document_hits(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """doc_id, run, place of documents' runs that items have, and some others."""
    sizes = sorted(r["size"] for r in runs.select("size").distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(bitmap(runs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            for first, data, offsets in text_slices(batch.column("text")):
                for _, row, hashes, place, _ in _runs(data, offsets, sizes):
                    slot = (hashes >> np.uint64(64 - _BITS)).astype(np.int64)
                    hit = ((bits[slot >> 3] >> (7 - (slot & 7))) & 1).astype(bool)
                    if not hit.any():
                        continue
                    row, hashes, place = row[hit], hashes[hit], place[hit]
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(first + row)), pa.array(hashes.view(np.int64)), pa.array(place.astype(np.int32))],
                        names=["doc_id", "run", "place"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, run long, place int")


def candidates(docs: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """doc_id, item_id, region of all pairs that share a run; a region is a stretch of STRIDE diagonals."""
    runs = materialise(item_runs(items, n))
    return (
        document_hits(docs, runs).join(runs.select("run", "item_id", F.col("place").alias("item_place")), "run")
        .select("doc_id", "item_id", F.floor((F.col("place") - F.col("item_place")) / STRIDE).cast("int").alias("region"))
        .distinct()
    )


def local_alignment(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(score, end in a, end in b) of the best local alignment of two sequences; ends are exclusive."""
    width = len(b)
    steps = np.arange(width + 1) * -GAP
    row = np.zeros(width + 1, dtype=np.int64)
    best, at = 0, (0, 0)
    for i in range(len(a)):
        new = np.zeros(width + 1, dtype=np.int64)
        np.maximum(row[:-1] + np.where(b == a[i], MATCH, MISMATCH), row[1:] + GAP, out=new[1:])
        np.maximum(new, 0, out=new)
        # gaps along the row: the best of all places before, less a gap for each step
        row = np.maximum.accumulate(new + steps) - steps
        j = int(row.argmax())
        if row[j] > best:
            best, at = int(row[j]), (i + 1, j)
    return best, *at


def align(item: np.ndarray, text: np.ndarray, region: int) -> tuple[float, int, int]:
    """(score, first word, word after the last) of the item's best alignment inside a region of the text."""
    slack = len(item) // 2 + 4
    low = max(0, region * STRIDE - slack)
    high = min(len(text), (region + 1) * STRIDE + len(item) + slack)
    part = text[low:high]
    score, item_end, end = local_alignment(item, part)
    if not score:
        return 0.0, low, low
    # the same alignment from its end backwards gives its start
    _, _, length = local_alignment(item[:item_end][::-1], part[:end][::-1])
    return score / (MATCH * len(item)), low + end - length, low + end


def leaks(
    docs: DataFrame, items: DataFrame, n: int = 3, threshold: float = 0.5, rare_share: float = 0.001, rare_least: int = 20,
    min_seeds: int = 8,
) -> DataFrame:
    """doc_id, item_id, score, start, end (code points of the document) of all pairs that score ``threshold`` or more.

    ``rare_share``, ``rare_least`` and ``min_seeds`` are accepted for callers that pass them; rarity decides nothing any more.
    """
    found = candidates(docs, items, n)
    grouped = found.groupBy("doc_id", "item_id").agg(F.sort_array(F.collect_set("region")).alias("regions"))
    with_items = grouped.join(
        items.select(F.col("item_id").alias("own_item"), F.col("text").alias("item_text")),
        F.col("item_id").eqNullSafe(F.col("own_item"))).drop("own_item")
    pairs = with_items.join(
        docs.select(F.col("doc_id").alias("own_doc"), "text"), F.col("doc_id").eqNullSafe(F.col("own_doc"))).select(
        "doc_id", "item_id", "regions", "item_text", "text")

    def hashed(column: pa.Array) -> list:
        out = []
        for _, data, offsets in text_slices(column):
            starts, ends, rows = words(data, offsets, PUNCTUATION)
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            hashes = span_hashes(data, starts, ends)
            edge = np.searchsorted(rows, np.arange(len(offsets)))
            for r in range(len(offsets) - 1):
                own = slice(edge[r], edge[r + 1])
                base = chars[offsets[r]]
                out.append((hashes[own], chars[starts[own]] - base, chars[ends[own]] - base))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                batch = whole.slice(i, 64)
                texts, own_items = hashed(batch.column("text")), hashed(batch.column("item_text"))
                rows = []
                for doc_id, item_id, regions, (t, starts, ends), (q, _, _) in zip(
                        batch.column("doc_id").to_pylist(), batch.column("item_id").to_pylist(),
                        batch.column("regions").to_pylist(), texts, own_items):
                    # no alignment matches more words of the item than the document holds
                    if not len(q) or not len(t) or np.isin(q, t).sum() < threshold * len(q):
                        continue
                    score, first, last = max((align(q, t, r) for r in regions), key=lambda x: (x[0], -x[1]))
                    if score >= threshold:
                        rows.append((doc_id, item_id, score, int(starts[first]), int(ends[last - 1])))
                if rows:
                    yield pa.RecordBatch.from_pylist(
                        [dict(zip(out.names, r)) for r in rows], schema=out)

    kinds = [docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}
    out = pa.schema([("doc_id", arrow[kinds[0]]), ("item_id", arrow[kinds[1]]), ("score", pa.float64()), ("start", pa.int32()), ("end", pa.int32())])
    scored = pairs.mapInArrow(run, f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, start int, end int")
    best = F.max_by(F.struct("score", "start", "end"), F.struct("score", -F.col("start"), -F.col("end")))
    return scored.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", "b.score", "b.start", "b.end")


def drop_leaked(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (all columns) in which no test item is found."""
    bad = leaks(docs, items, **options).select(F.col("doc_id").alias("__leak_doc")).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col("__leak_doc")), "left_anti")
