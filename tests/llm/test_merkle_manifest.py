import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import EDGES
from dyadspark.llm import merkle_manifest as mm
from dyadspark.llm.queries import QUERIES


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields):
    return h(*("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def climb(level):
    """All levels of a tree."""
    levels = [level]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        j = i ^ 1
        out.append((i % 2 == 1, level[j]) if j < len(level) else None)
        i //= 2
    return out


def fold(leaf, path):
    for s in path:
        leaf = h(leaf) if s is None else h(s[1], leaf) if s[0] else h(leaf, s[1])
    return leaf


def brute(rows):
    """rows: (doc_id, lang, leaf) -> sorted [(doc_id, leaf, subroot, root, path)]"""
    groups = {}
    for d, lang, leaf in rows:
        groups.setdefault("-" if lang is None else ":" + lang, []).append((d is not None, d or 0, leaf, d))
    trees = {g: climb([leaf for _, _, leaf, _ in sorted(v, key=lambda x: x[:3])]) for g, v in groups.items()}
    names = sorted(trees, key=lambda g: g.encode())
    top = climb([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for i, (_, _, leaf, d) in enumerate(sorted(groups[g], key=lambda x: x[:3])):
            path = siblings(trees[g], i) + siblings(top, k)
            out.append((d, leaf, trees[g][-1][0], top[-1][0], path))
    return out


def told(row):
    return repr((row[0] is None, row))


def proved(docs, bits):
    rows = docs.select("doc_id", "lang", mm.leaf_digest(F.col("doc_id"), F.col("text")).alias("leaf"))
    leaves, nodes, trees = mm.manifest(rows, "lang", "doc_id", bits)
    return leaves, nodes, trees


def as_rows(df):
    return sorted(
        ((r.doc_id, r.digest, r.subroot, r.root, [None if s.digest is None else (s.left, s.digest) for s in r.siblings])
         for r in df.collect()), key=told)


def wanted(docs):
    return brute([(r.doc_id, r.lang, leaf_of(r.doc_id, r.text)) for r in docs.collect()])


@pytest.mark.parametrize("bits", [2, 12])
def test_proofs_equal_brute_force(corpus, bits):
    leaves, nodes, trees = proved(corpus, bits)
    assert as_rows(mm.whole_proofs(leaves.drop("lang", "leaf"), leaves, nodes, trees, bits)) == sorted(wanted(corpus), key=told)


def test_requests_shared_by_many_partitions(make):
    docs = make([(3 * i, f"text {i}") for i in range(700)])  # one group, 350 partitions of two leaves
    leaves, nodes, trees = proved(docs, 1)
    assert as_rows(mm.whole_proofs(leaves.drop("lang", "leaf"), leaves, nodes, trees, 1)) == sorted(wanted(docs), key=told)


def test_proofs_of_some_rows(corpus):
    leaves, nodes, trees = proved(corpus, 3)
    asked = leaves.where("doc_id % 7 = 3").drop("lang", "leaf")
    want = [r for r in wanted(corpus) if r[0] % 7 == 3]
    assert as_rows(mm.whole_proofs(asked, leaves, nodes, trees, 3)) == sorted(want, key=told)


def test_octopus_is_minimal():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        asked = np.unique(rng.integers(0, n, size=int(rng.integers(1, 8))))
        levels = climb([str(i) for i in range(n)])
        need, below = set(), {(0, int(i)) for i in asked}
        for i in asked:
            for level in range(len(levels) - 1):
                j = (int(i) >> level) ^ 1
                if j < len(levels[level]):
                    need.add((level, j))
        for level in range(len(levels) - 1):  # what follows from the asked leaves and from needed nodes is not fetched
            below |= {(level + 1, i >> 1) for at, i in below if at == level}
        got = {(level, int(i)) for level, found in mm.missing_nodes(asked, n) for i in found}
        assert got == need - below


def test_edge_cases(edges, clashing, no_docs):
    for docs in (edges, clashing):
        leaves, nodes, trees = proved(docs, 2)
        got = as_rows(mm.whole_proofs(leaves.drop("lang", "leaf"), leaves, nodes, trees, 2))
        assert got == sorted(wanted(docs), key=told)
    leaves, nodes, trees = proved(no_docs, 2)
    assert mm.whole_proofs(leaves.drop("lang", "leaf"), leaves, nodes, trees, 2).count() == 0
    one = no_docs.unionByName(edges.where("doc_id = 4"))
    leaves, nodes, trees = proved(one, 2)
    row = mm.whole_proofs(leaves.drop("lang", "leaf"), leaves, nodes, trees, 2).first()
    assert row.digest == row.subroot == row.root == leaf_of(4, "one") and row.siblings == []


def test_query_finds_what_was_changed(spark, folder):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    leaves = {d: leaf_of(d, r.source, r.lang, r.n_chars, r.text) for d, r in docs.items()}
    want = {r[0]: r[1:] for r in brute([(d, docs[d].lang, leaf) for d, leaf in leaves.items()])}
    rows = QUERIES["op12_merkle_manifest"](spark, folder).collect()
    assert len(rows) == len(docs)
    for r in rows:
        leaf, subroot, root, path = want[r.doc_id]
        assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (leaf, subroot, root, h(*(s[1] for s in path if s)))
        d = docs[r.doc_id]
        hit = zlib.crc32(str(r.doc_id).encode()) % 7 == 0 and d.n_chars is not None
        start = leaf_of(d.doc_id, d.source, d.lang, d.n_chars + 1, d.text) if hit else leaf
        assert r.folded_root == fold(start, path) and r.verified == (not hit)
