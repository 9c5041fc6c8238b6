"""Packing documents into sequences by shortest-pack-first over the histogram of piece lengths.

1. Every document is tokenised once, its end token added, and cut into full pieces of ``capacity`` tokens and a remainder. The piece
   rows (with their ids only where asked for) are written.
2. The histogram of piece lengths, at most ``capacity`` rows, goes to the driver. Lengths are placed longest first, each piece
   into the shortest open pack that exists (the one with most space), all pieces of a length and all packs of a pattern at once:
   the plan's size depends on ``capacity`` alone, not on the number of documents.
3. Pieces are ranked by (length, document, start) over ranges. The plan says of every stretch of ranks into which sequences
   and at which offset its pieces go, so each piece finds its place by a binary search in a broadcast table.

Size of the plan: a step that finds fewer pieces than packs splits one pattern, so there are at most two patterns for each length, and a
pattern of distinct lengths that add up to ``capacity`` has at most sqrt(2 * capacity) of them: under 2 * 2048 * 64 stretches for a capacity of 2048.

Padding is what space no shorter piece is left for; with the usual number of short pieces it is a few tokens a sequence. Where all pieces
are longer than half a sequence, nothing fits beside them and they are padded, since pieces are cut at multiples of ``capacity`` only.

Ids are those of the library: a text's pre-tokens, cut by the tokenizer's own pattern, are looked up in a cache whose misses the library
encodes (its model alone, on the byte characters of the pre-token); ids of pre-tokens do not depend on one another. Texts with characters beyond U+024F are cut by the library's own
pre-tokenizer. Strings of special tokens inside a text become their id, the library's default.

Null and empty texts hold the end token alone; rows with one doc_id are documents of their own (their pieces share it); equal rows give
equal pieces; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from dyadspark.operators.ranking import ranked
from dyadspark.session import materialise

CAPACITY = 2048
_LAST_FAST = 0x24F
_LONGEST = 40
_BATCH_BYTES = 1 << 22


def _characters(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_LAST_FAST + 1) if unicodedata.category(chr(c))[0] == kind)


_LETTERS, _NUMBERS = _characters("L"), _characters("N")
_BLANKS = "".join(re.escape(chr(c)) for c in (*range(0x09, 0x0E), 0x20, 0x85, 0xA0))
_FAST = re.compile(f"[\0-{chr(_LAST_FAST)}]*")
#: The tokenizer's own pattern, with its classes written out for the characters of the fast path.
_PRE_TOKENS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^{_BLANKS}{_LETTERS}{_NUMBERS}]+"
    f"|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"
)


class Encoder(dict):
    """Ids of texts as little-endian 32-bit bytes, through a cache of the ids of pre-tokens.

    The cache has two generations of half its size: when the young one is full it becomes the old one, and old entries
    that are asked for again move over, so frequent pre-tokens stay however many rare ones pass.
    """

    def __init__(self, definition: str, cache_size: int):
        super().__init__()
        self._tokenizer, self._half, self._old = Tokenizer.from_str(definition), cache_size // 2, {}
        self._model = self._tokenizer.model
        self._special = {t["content"]: _packed([t["id"]]) for t in json.loads(definition)["added_tokens"]}
        longest_first = sorted(self._special, key=len, reverse=True)
        self._cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None

    def __missing__(self, pre_token: str) -> bytes:
        ids = self._old.pop(pre_token, None)
        if ids is None:
            tokens = self._model.tokenize(pre_token.encode().decode("latin-1").translate(_BYTE_CHARACTERS))
            ids = _packed([t.id for t in tokens])
        if len(pre_token) <= _LONGEST:
            if len(self) >= self._half:
                self._old = dict(self)
                self.clear()
            self[pre_token] = ids
        return ids

    def _pre_tokens(self, text: str) -> list[str]:
        if _FAST.fullmatch(text):
            return _PRE_TOKENS.findall(text)
        return [text[a:b] for _, (a, b) in self._tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def ids(self, text: str) -> bytes:
        parts = [text] if self._cut is None or "<|" not in text else self._cut.split(text)
        return b"".join(
            self._special[p] if i % 2 else b"".join(map(self.__getitem__, self._pre_tokens(p)))
            for i, p in enumerate(parts))


@lru_cache(maxsize=1)
def encoder(definition: str, cache_size: int) -> Encoder:
    """The worker's encoder; its cache lives on from task to task."""
    return Encoder(definition, cache_size)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def byte_characters() -> dict[int, int]:
    """The characters that stand for bytes in a byte-level vocabulary: visible Latin-1 characters for themselves, the others, in
    ascending order, by U+0100 and on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 0x100 + i for i, b in enumerate(hidden)}


_BYTE_CHARACTERS = byte_characters()


def cut_documents(
    docs: DataFrame, path: str, end_id: int, capacity: int = CAPACITY, with_ids: bool = False, cache_size: int = 1 << 20
) -> DataFrame:
    """The pieces of all documents: doc_id, start (ids before it), length, ids_crc32 (of little-endian 32-bit ids), doc_tokens, and,
    where asked for, ids (those bytes). ``path`` is the definition of a byte-level tokenizer with the pattern above."""
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = _packed([end_id])
    names = ["start", "length", "ids_crc32", "doc_tokens"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(shared.value, cache_size).ids

        def out(keys: pa.Array, rows: list, of: list[int], pieces: list[bytes]) -> pa.RecordBatch:
            columns = [keys.take(pa.array(of, pa.int64()))]
            columns += [pa.array([r[i] for r in rows], pa.int64()) for i in range(4)]
            if with_ids:
                columns.append(pa.array(pieces, pa.binary()))
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", *names, *(["ids"] if with_ids else [])])

        for batch in batches:
            keys, rows, of, pieces, held = batch.column("doc_id"), [], [], [], 0
            for i, text in enumerate(batch.column("text")):
                ids = ids_of(text.as_py() or "") + end
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    piece = ids[4 * start : 4 * (start + capacity)]
                    rows.append((start, len(piece) // 4, zlib.crc32(piece), n))
                    of.append(i)
                    if with_ids:
                        pieces.append(piece)
                        held += len(piece)
                if held > _BATCH_BYTES:
                    yield out(keys, rows, of, pieces)
                    rows, of, pieces, held = [], [], [], 0
            if rows:
                yield out(keys, rows, of, pieces)

    schema = f"doc_id {kind}, {', '.join(f'{n} long' for n in names)}" + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def pack_lengths(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Patterns and how many packs have each. A pattern is ((length, copies), ...), longest first, and fills up to ``capacity``."""
    open_packs: dict[int, list] = {}  # space -> [(pattern, packs)]
    done: list = []

    def put(pattern, packs, space):
        if space:
            open_packs.setdefault(space, []).append((pattern, packs))
        else:
            done.append((pattern, packs))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            space = max(open_packs, default=0)
            if space < length:  # new packs, as full of this length as it goes
                most = capacity // length
                if left >= most:
                    put(((length, most),), left // most, capacity - most * length)
                if left % most:
                    put(((length, left % most),), 1, capacity - left % most * length)
                break
            groups = open_packs.pop(space)
            below = max(open_packs, default=0)
            # one piece after another goes to the pack with most space: that many until another space is the largest
            copies = min((space - below) // length + 1, space // length)
            for g, (pattern, packs) in enumerate(groups):
                take = min(copies, max(1, left // packs))
                filled = min(packs, left // take)
                if filled:
                    put((*pattern, (length, take)), filled, space - take * length)
                    left -= filled * take
                if filled < packs:
                    open_packs.setdefault(space, []).append((pattern, packs - filled))
                if not left:
                    open_packs.setdefault(space, []).extend(groups[g + 1 :])
                    if not open_packs[space]:
                        del open_packs[space]
                    break
    return done + [g for groups in open_packs.values() for g in groups]


def stretches(patterns: list, histogram: dict[int, int]) -> np.ndarray:
    """The plan by rank: rows of (first rank, copies in a pack, first sequence, offset, length), by first rank.

    Ranks go through the lengths in ascending order. A pattern's packs are consecutive sequences, and those of one length in it are a
    stretch of ranks: ``copies`` ranks for each of the packs.
    """
    first, total = {}, 0
    for length in sorted(histogram):
        first[length] = total
        total += histogram[length]
    rows, sequence = [], 0
    for pattern, packs in patterns:
        offset = 0
        for length, copies in pattern:
            rows.append((first[length], copies, sequence, offset, length))
            first[length] += copies * packs
            offset += copies * length
        sequence += packs
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack(
    docs: DataFrame, path: str, end_id: int = 1, capacity: int = CAPACITY, with_ids: bool = False, cache_size: int = 1 << 20
) -> DataFrame:
    """All pieces of all documents with sequence_id and offset (0.. without gaps in its sequence); columns of ``cut_documents``."""
    pieces = materialise(cut_documents(docs, path, end_id, capacity, with_ids, cache_size))
    counts = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    histogram = {r.length: r.n for r in counts}
    plan = stretches(pack_lengths(histogram, capacity), histogram)
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    # the last key keeps the ranges even where one document has many equal rows
    numbered = pieces.withColumn("_row", F.monotonically_increasing_id())
    in_order = ranked(numbered, "length", F.col("doc_id").asc_nulls_first(), "start", "ids_crc32", "_row", rank="_rank").drop("_row")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, copies, sequence, offset, length = shared.value.T
        for batch in batches:
            ranks = batch.column("_rank").to_numpy()
            at = np.searchsorted(first, ranks, side="right") - 1
            packs, nth = np.divmod(ranks - first[at], copies[at])
            columns = [batch.column(n) for n in kept]
            columns += [pa.array(sequence[at] + packs), pa.array(offset[at] + nth * length[at])]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    kept = pieces.columns
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return in_order.mapInArrow(place, f"{types}, sequence_id long, offset long")


def sequences(packed: DataFrame, pad_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, n_tokens, doc_ids and ids (array, padded to ``capacity`` unless the length is a power of two) of every sequence.

    ``packed`` comes from ``pack(..., with_ids=True)``. A sequence's pieces, at most ``capacity`` tokens, meet in one row.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for parts in batch.column("parts").to_pylist():
                row = np.frombuffer(b"".join(p["ids"] for p in parts), dtype="<u4").astype(np.int32)
                if len(row) & (len(row) - 1):
                    row = np.concatenate([row, np.full(capacity - len(row), pad_id, dtype=np.int32)])
                ids.append(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("sequence_id"), batch.column("n_tokens"), batch.column("doc_ids"), pa.array(ids, pa.list_(pa.int32()))],
                names=["sequence_id", "n_tokens", "doc_ids", "ids"])

    kind = packed.schema["doc_id"].dataType.simpleString()
    grouped = packed.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids"))).alias("parts"))
    return grouped.withColumn("doc_ids", F.col("parts.doc_id")).select("sequence_id", "n_tokens", "doc_ids", "parts").mapInArrow(
        join, f"sequence_id long, n_tokens long, doc_ids array<{kind}>, ids array<int>")
