"""Token counts of whole texts by a two-tier lookup on the map side.

A text's count is the sum of the lengths (in tokens) of its pre-tokens. Tier one is a hash table of the lengths of the corpus's
most frequent pre-tokens, broadcast to all workers; tier two is a cache in each worker, whose misses are encoded by the
library. No pre-token is shuffled: to find the frequent ones every task sums up all its texts in a bounded counter and
hands on only the ``per_task`` largest. The table decides speed alone; counts do not depend on it.

Bounds: the table holds ``table_size`` entries, a cache ``cache_size``; pre-tokens of more than 40 characters are in
neither. Texts with characters beyond U+024F, whose normal forms and classes need the library's own tables, are encoded whole by the
library, so results equal it for every text. Strings of special tokens inside a text count as the library counts them,
one token each.

Null texts count as empty (0 tokens); equal rows give equal rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

_LAST_FAST = 0x24F
#: Lower-cased to two characters; left to the library.
_NOT_FAST = {0x130}
_SPACES = {*range(0x09, 0x0E), 0x20, 0x85, 0xA0}
_LONGEST = 40


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_LAST_FAST + 1) if unicodedata.category(chr(c))[0] == kind)


_FAST = re.compile("[" + "".join(re.escape(chr(c)) for c in range(_LAST_FAST + 1) if c not in _NOT_FAST) + "]*")
_LETTERS, _NUMBERS = _class("L"), _class("N")
_BLANKS = "".join(re.escape(chr(c)) for c in sorted(_SPACES))
#: The tokenizer's own pattern, with its classes written out for the characters of the fast path.
_PRE_TOKENS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+"
)


class PreTokens:
    """Pre-tokens of texts of the fast path, cut at special tokens."""

    def __init__(self, definition: str):
        special = [t["content"] for t in json.loads(definition)["added_tokens"]]
        self._special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def fits(self, text: str) -> bool:
        return _FAST.fullmatch(text) is not None

    def split(self, text: str) -> tuple[int, list[str]]:
        """Number of special tokens and the pre-tokens between them."""
        if "<|" not in text or self._special is None:
            return 0, _PRE_TOKENS.findall(text.lower())
        parts = self._special.split(text)
        return len(parts) - 1, [t for p in parts for t in _PRE_TOKENS.findall(p.lower())]


class Lengths(dict):
    """Tier one's table with tier two's cache on top; a miss in both is encoded."""

    def __init__(self, frequent: dict[str, int], tokenizer: Tokenizer, cache_size: int):
        super().__init__(frequent)
        self._frequent, self._tokenizer, self._most = frequent, tokenizer, len(frequent) + cache_size

    def __missing__(self, pre_token: str) -> int:
        n = len(self._tokenizer.encode(pre_token, add_special_tokens=False).ids)
        if len(pre_token) <= _LONGEST:
            if len(self) >= self._most:
                self.clear()
                self.update(self._frequent)
            self[pre_token] = n
        return n


def _texts(batch: pa.RecordBatch) -> Iterator[str]:
    for text in batch.column("text"):
        yield text.as_py() or ""


def frequent_pre_tokens(docs: DataFrame, definition: str, table_size: int, per_task: int) -> list[str]:
    """The pre-tokens with the largest sums over the tasks' counters, at most ``table_size``."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, counts = PreTokens(definition), Counter()
        for batch in batches:
            for text in _texts(batch):
                if cut.fits(text):
                    counts.update(cut.split(text)[1])
                if len(counts) > 32 * per_task:
                    counts = Counter(dict(counts.most_common(8 * per_task)))
        top = [(t, n) for t, n in counts.most_common(per_task) if n > 1 and len(t) <= _LONGEST]
        yield pa.RecordBatch.from_pydict(
            {"pre_token": pa.array([t for t, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    rows = (
        docs.select("text").mapInArrow(summary, "pre_token string, n long")
        .groupBy("pre_token").agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "pre_token").limit(table_size).collect()
    )
    return [r.pre_token for r in rows]


def count_tokens(
    docs: DataFrame,
    path: str,
    limit: int = 2048,
    table_size: int = 1 << 16,
    per_task: int = 1 << 13,
    cache_size: int = 1 << 18,
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than ``limit`` tokens) of every row of ``docs``.

    ``path`` is the tokenizer's definition; its pre-tokenizer must be the pattern above (``word_bpe_49k.json``).
    """
    with open(path, encoding="utf-8") as f:
        definition = f.read()
    tokenizer = Tokenizer.from_str(definition)
    frequent = {
        t: len(tokenizer.encode(t, add_special_tokens=False).ids)
        for t in frequent_pre_tokens(docs, definition, table_size, per_task)
    }
    shared = docs.sparkSession.sparkContext.broadcast((definition, frequent))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        definition, frequent = shared.value
        own = Tokenizer.from_str(definition)
        cut, lengths = PreTokens(definition), Lengths(frequent, own, cache_size)
        length_of = lengths.__getitem__
        for batch in batches:
            counts = []
            for text in _texts(batch):
                if cut.fits(text):
                    special, pre_tokens = cut.split(text)
                    counts.append(special + sum(map(length_of, pre_tokens)))
                else:
                    counts.append(len(own.encode(text, add_special_tokens=False).ids))
            size = pc.fill_null(pc.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), size, pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
