import itertools
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import EDGES
from dyadspark.llm import hilbert_shards as hs, token_counts as tc
from dyadspark.llm.queries import QUERIES, WORD_BPE

PATH = public_tokenizers.path(WORD_BPE)


def test_curve_visits_every_cell_and_moves_to_a_neighbour(spark):
    bits, n = 3, 3
    cells = spark.createDataFrame(list(itertools.product(range(1 << bits), repeat=n)), ["x", "y", "z"])
    rows = cells.withColumn("h", hs.hilbert_index([F.col(c) for c in ("x", "y", "z")], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(1 << (bits * n)))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(a[i] - b[i]) for i in range(n)) == 1


def check_shards(rows, n, shards=16):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert sum(map(len, by.values())) == n
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_shards_of_the_corpus(spark, folder, corpus_rows):
    rows = QUERIES["op1_hilbert_shards"](spark, folder).collect()
    check_shards(rows, len(corpus_rows))
    texts = dict(corpus_rows)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def test_runs_follow_the_curve_and_prune(corpus):
    placed = hs.document_shards(corpus).cache()
    rows = placed.orderBy("shard", "slot").collect()
    assert [r.hilbert for r in rows] == sorted(r.hilbert for r in rows)
    boxes = hs.shard_boxes(placed, ["n_chars", "lang"]).collect()
    wide = max(r.n_chars for r in rows)
    assert sum(b.max_n_chars - b.min_n_chars for b in boxes) < 0.6 * wide * len(boxes)


def test_shards_of_edge_cases(edges, clashing, no_docs):
    for docs in (edges, clashing):
        rows = hs.document_shards(docs).collect()
        check_shards(rows, len(EDGES))
        assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (1, 2)} == {(1, 0)}
    assert hs.document_shards(no_docs).count() == 0
    with pytest.raises(ValueError):
        hs.hilbert_shards(clashing, ["lang"], "doc_id")


def test_one_cell_may_hold_all_rows(make):
    rows = hs.document_shards(make([(i, "same") for i in range(0, 600, 6)])).collect()
    check_shards(rows, 100)


def test_written_shards(corpus, tmp_path, spark):
    hs.write_shards(hs.document_shards(corpus, 4), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().count() == 4


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_fast_path_equals_the_library_for_every_character(library):
    with open(PATH, encoding="utf-8") as f:
        cut = tc.PreTokens(f.read())
    for c in map(chr, range(tc._LAST_FAST + 1)):
        for text in (c, f"a{c}b", f"1{c}2", f"!{c}?", f" {c} {c}{c} A{c}", f"it{c}s I'{c}ll"):
            if cut.fits(text):
                special, tokens = cut.split(text)
                n = special + sum(len(library.encode(t, add_special_tokens=False).ids) for t in tokens)
                assert n == len(library.encode(text, add_special_tokens=False).ids), repr(text)
            else:
                assert ord(c) in tc._NOT_FAST


@pytest.mark.parametrize("table_size, cache_size", [(1 << 16, 1 << 18), (10, 3)])
def test_counts_equal_the_library(corpus, corpus_rows, library, table_size, cache_size):
    got = {r.doc_id: r for r in tc.count_tokens(corpus, PATH, table_size=table_size, cache_size=cache_size).collect()}
    for d, t in corpus_rows:
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (got[d].n_tokens, got[d].n_bytes, got[d].over_limit) == (n, len(t.encode()), n > 2048)


def test_counts_of_edge_cases(edges, clashing, no_docs, library):
    for docs in (edges, clashing):
        got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in tc.count_tokens(docs, PATH).collect())
        assert got == sorted(
            (str(d), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in EDGES)
    assert tc.count_tokens(no_docs, PATH).collect() == []
