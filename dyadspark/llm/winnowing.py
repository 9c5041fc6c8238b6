"""Document fingerprints by winnowing.

Hashes of all runs of ``k`` code points are rolled along a text; of every ``window`` consecutive hashes the smallest is
chosen, the rightmost if several are equal, and kept with its position. Two texts that share a run of at least ``window + k - 1``
code points share a fingerprint; runs shorter than ``k`` are never matched. A text shorter than ``k`` has one fingerprint, its
whole hash at position 0; a text with fewer hashes than a window has the smallest of them; an empty or null text has none.

Hashes are 32 bits wide, fixed by the text alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from dyadspark.llm.hashing import mix, powers

_PLACE = np.uint64(0xFFFFFFFF)


def rolling_hashes(text: str, k: int) -> np.ndarray:
    """32-bit hashes of all runs of k code points; of the whole text if it is shorter."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    n = len(codes)
    if not n:
        return codes
    k = min(k, n)
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(mix(codes + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * down[: n - k + 1] + np.uint64(k)) >> np.uint64(32)


def winnow(text: str, k: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of a text's fingerprint, by position."""
    hashes = rolling_hashes(text, k)
    n = len(hashes)
    if not n:
        return hashes.astype(np.uint32), np.zeros(0, dtype=np.int32)
    # the smallest key is the smallest hash, and of equal ones that furthest right
    keys = (hashes << np.uint64(32)) | (_PLACE - np.arange(n, dtype=np.uint64))
    width, size = min(window, n), 1
    while size < width:
        step = min(size, width - size)
        keys = np.minimum(keys[: len(keys) - step], keys[step:])
        size += step
    chosen = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return (chosen >> np.uint64(32)).astype(np.uint32), (_PLACE - (chosen & _PLACE)).astype(np.int32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared hashes of all hashes of two fingerprints; two empty ones are alike."""
    a, b = np.unique(a), np.unique(b)
    if not len(a) and not len(b):
        return 1.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def as_text(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = 16, window: int = 32) -> DataFrame:
    """doc_id, n_chars, fingerprint (8 hex digits a hash, by position), positions of every row of ``docs``.

    Rows are kept as they are: null texts have an empty fingerprint, repeated rows repeat, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _small(batch):
                texts = [t or "" for t in part.column("text").to_pylist()]
                found = [winnow(t, k, window) for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(map(len, texts), pa.int64()),
                     pa.array([as_text(h) for h, _ in found], pa.string()), _lists([p for _, p in found])],
                    names=["doc_id", "n_chars", "fingerprint", "positions"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_chars long, fingerprint string, positions array<int>")


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, dtype=np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, dtype=np.int32)])))


def _small(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def in_order_with_next(docs: DataFrame, parts: int) -> DataFrame:
    """Rows dealt to ``parts`` ranges of doc_id and sorted, each range closed by a copy of the row that follows it.

    Returns part, closing, doc_id, text. The last range is closed by the table's first row. Range limits are quantiles, so
    they follow the rows and not the values. Only one row a range is moved twice.
    """
    rows = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10_000).alias("cuts"))
    limits: list = cuts.first().cuts or []
    limits = sorted(set(limits)) if parts > 1 else []

    def part_of(doc_id: Column) -> Column:
        found = F.size(F.filter(F.array(*map(F.lit, limits)), lambda c: c <= doc_id)) if limits else F.lit(0)
        return F.when(doc_id.isNull(), F.lit(0)).otherwise(found)

    rows = rows.withColumn("part", part_of(F.col("doc_id")))
    # nulls come first; at most ``parts`` rows from here to the broadcast
    firsts = rows.groupBy("part").agg(
        F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("has_null"))
    order = Window.partitionBy(F.lit(0)).orderBy("part")
    whole = Window.partitionBy(F.lit(0))
    firsts = firsts.select(
        F.col("part").alias("from_part"), F.when(~F.col("has_null"), F.col("least")).alias("first_id"),
        F.coalesce(F.lag("part").over(order), F.max("part").over(whole)).alias("to_part"))
    closing = rows.join(
        F.broadcast(firsts), (F.col("part") == F.col("from_part")) & F.col("doc_id").eqNullSafe(F.col("first_id")))
    return (
        rows.select("part", F.lit(False).alias("closing"), "doc_id", "text")
        .unionByName(closing.select(F.col("to_part").alias("part"), F.lit(True).alias("closing"), "doc_id", "text"))
        .repartition(max(parts, 1), "part")
        .sortWithinPartitions("part", "closing", F.col("doc_id").asc_nulls_first(), "text")
    )


def compare_with_edits(docs: DataFrame, parts: int, k: int = 16, window: int = 32) -> DataFrame:
    """Each row's fingerprint against that of its edited text and that of the next row.

    The next row is the next by doc_id (nulls first, equal ids by text), after the last the first. The edited text has the
    last floor(n_chars / 2) code points replaced by the next text's first as many (or all it has). Returns doc_id, n_chars,
    edited_sha256, fingerprint, positions, edited_fingerprint, near_edited, near_next.
    """

    def one(doc_id, text: str, mine: tuple, following: str, theirs: tuple) -> tuple:
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        changed = mine if edited == text else winnow(edited, k, window)
        return (
            doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(mine[0]),
            mine[1], as_text(changed[0]), likeness(mine[0], changed[0]), likeness(mine[0], theirs[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, open_row, closed, out = None, None, False, []
        for batch in batches:
            for small in _small(batch):
                for p, closing, doc_id, text in zip(*(c.to_pylist() for c in small.columns)):
                    if p != part:
                        part, open_row, closed = p, None, False
                    if closed:  # equal first ids: only the first of them closes
                        continue
                    print_ = winnow(text, k, window)
                    if open_row is not None:
                        out.append(one(*open_row, text, print_))
                    open_row, closed = (doc_id, text, print_), closing
                if out:
                    yield batch_of(out)
                    out = []

    kind = docs.schema["doc_id"].dataType
    arrow_id = {"int": pa.int32(), "bigint": pa.int64()}.get(kind.simpleString(), pa.int64())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows))
        return pa.RecordBatch.from_arrays(
            [pa.array(c[0], arrow_id), pa.array(c[1], pa.int64()), pa.array(c[2], pa.string()), pa.array(c[3], pa.string()),
             _lists(c[4]), pa.array(c[5], pa.string()), pa.array(c[6], pa.float64()), pa.array(c[7], pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "positions", "edited_fingerprint", "near_edited",
                   "near_next"])

    return in_order_with_next(docs, parts).mapInArrow(
        run, f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, positions array<int>, "
        "edited_fingerprint string, near_edited double, near_next double")
