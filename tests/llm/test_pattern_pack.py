import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from conftest import EDGES
from dyadspark.llm import pattern_pack as pp
from dyadspark.llm.queries import BYTE_BPE, QUERIES

PATH = public_tokenizers.path(BYTE_BPE)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text, end=1):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def check(rows, texts, library, capacity):
    """rows against the library's ids: every id in one piece, checksums, sequences without gaps and overlaps."""
    want = Counter()
    for d, t in texts:
        ids = ids_of(library, t)
        for a in range(0, len(ids), capacity):
            part = ids[a : a + capacity]
            want[d, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    packs = {}
    for r in rows:
        packs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(packs) == list(range(len(packs)))
    for parts in packs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return packs


def test_pieces_of_the_corpus(spark, folder, corpus_rows, library):
    rows = QUERIES["op11_pattern_pack"](spark, folder).collect()
    packs = check(rows, corpus_rows, library, 2048)
    filled = [sum(n for _, n in p) for p in packs.values()]
    padding = sum(2048 - n for n in filled if n & (n - 1))
    assert padding < 0.02 * 2048 * len(packs)


def test_edge_cases(edges, clashing, no_docs, library):
    for docs in (edges, clashing):
        check(pp.pack(docs, PATH).collect(), EDGES, library, 2048)
        check(pp.pack(docs, PATH, capacity=16).collect(), EDGES, library, 16)
    assert pp.pack(no_docs, PATH).count() == 0
    assert pp.sequences(pp.pack(no_docs, PATH, with_ids=True)).count() == 0


def test_one_key_with_most_rows(make, library):
    texts = [(7, f"text {i % 3}") for i in range(300)] + [(None, None)] * 150 + [(i, "word " * i) for i in range(50)]
    check(pp.pack(make(texts), PATH, capacity=64).collect(), texts, library, 64)


def test_sequences_hold_the_documents(make, library):
    texts = [(i, "some words of a text " * (i % 23)) for i in range(60)]
    packed = pp.pack(make(texts), PATH, capacity=64, with_ids=True)
    whole = {r.sequence_id: r for r in pp.sequences(packed, pad_id=0, capacity=64).collect()}
    pieces = {}
    for r in packed.collect():
        seq = whole[r.sequence_id]
        pieces.setdefault(r.doc_id, {})[r.start] = seq.ids[r.offset : r.offset + r.length]
        assert r.doc_id in seq.doc_ids
    for d, t in texts:
        assert [x for _, p in sorted(pieces[d].items()) for x in p] == ids_of(library, t)
    for seq in whole.values():
        n = seq.n_tokens
        assert len(seq.ids) == (64 if n & (n - 1) else n) and not any(seq.ids[n:])


def shortest_first_one_by_one(histogram, capacity):
    """The packs' fill levels when pieces are placed one at a time."""
    space = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            most = max(space, default=0)
            if most < length:
                space.append(capacity - length)
            else:
                space[space.index(most)] -= length
    return sorted(space)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_placing_one_at_a_time(seed):
    rng = np.random.default_rng(seed)
    capacity = int(rng.integers(5, 60))
    histogram = {int(n): int(rng.integers(1, 40)) for n in rng.integers(1, capacity + 1, size=int(rng.integers(1, 20)))}
    plan = pp.pack_lengths(histogram, capacity)
    back, space = Counter(), []
    for pattern, packs in plan:
        for length, copies in pattern:
            back[length] += copies * packs
        space += [capacity - sum(a * b for a, b in pattern)] * packs
    assert back == histogram and min(space) >= 0
    assert len(plan) <= 2 * len(histogram) + 2
    whole = shortest_first_one_by_one(histogram, capacity)
    assert len(space) == len(whole) and sum(space) == sum(whole)


def test_encoder_on_foreign_text_and_small_cache(library):
    encoder = pp.Encoder(open(PATH, encoding="utf-8").read(), 4)
    texts = [
        "it's   what\n\n it \t was’ — café", "日本語 text 😀  ", "a<|endoftext|> b<|endoftext|>", "x\x1c\x1f y\x85z\xa0 \xa0q", "١٢٣ ⅷ ②",
        "　wide blank ", "don't DON'T 'tis", "ꙮ̀ é", " " * 50 + "x", "a" * 500]
    for t in texts * 2:
        assert np.frombuffer(encoder.ids(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(encoder) <= 2
