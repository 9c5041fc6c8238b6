import hashlib
import random
import zlib

import pytest

from brute import WORD
from conftest import EDGES
from dyadspark.llm import periodic_runs as pr
from dyadspark.llm.queries import QUERIES


def brute_runs(words, least_words=6, least_exponent=4):
    """All maximal stretches of each period, without those whose smallest period is less."""
    n, out = len(words), set()
    for q in range(1, n // least_exponent + 1):
        start = 0
        while start + q < n:
            end = start
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end - start + q
            part = words[start : start + length]
            if end > start and length >= max(least_words, least_exponent * q) and not any(
                part[r:] == part[:-r] for r in range(1, q)
            ):
                out.add((start, length, q))
            start = end + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(doc_id, text, scramble=True):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if scramble and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    told = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def as_tuple(r):
    return (r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(150):
        n, letters = rng.randrange(80), rng.choice([1, 2, 2, 3, 6])
        words = [b"%d" % rng.randrange(letters) for _ in range(n)]
        if n > 20 and rng.random() < 0.6:
            p, a = rng.randint(1, 6), rng.randrange(n - 10)
            words = [words[a + (i - a) % p] if a <= i < a + 40 else w for i, w in enumerate(words)]
        for limits in ((6, 4), (2, 2), (5, 3)):
            assert [tuple(r) for r in pr.text_runs(words, *limits).tolist()] == brute_runs(words, *limits)


def test_nested_and_touching_runs():
    for text in ("a a a a b " * 6, "a b a b a b a b a b c c c c c c", "x y z " * 9 + "y z " * 9, "a " * 5, "a " * 6):
        words = text.encode().split()
        assert [tuple(r) for r in pr.text_runs(words).tolist()] == brute_runs(words)


def test_extensions_and_order_equal_direct_comparison():
    rng = random.Random(3)
    for _ in range(60):
        s = [rng.randrange(3) for _ in range(rng.randrange(1, 40))] + [3]
        e = pr.Extensions(s)
        assert sorted(range(len(s)), key=lambda i: s[i:]) == e.rank.argsort().tolist()
        pairs = [(i, j) for i in range(len(s)) for j in range(len(s)) if i != j]
        got = e.common(*map(pr.np.array, zip(*pairs)))
        for (i, j), n in zip(pairs, got):
            k = 0
            while max(i, j) + k < len(s) and s[i + k] == s[j + k]:
                k += 1
            assert n == k


def test_query_equals_brute_force(spark, folder, corpus_rows):
    rows = QUERIES["op13_periodic_runs"](spark, folder).collect()
    short = {d: t for d, t in corpus_rows if len(t) < 9000}
    assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in corpus_rows)
    for r in rows:
        if r.doc_id in short:
            assert as_tuple(r) == brute_row(r.doc_id, short[r.doc_id])


def test_edge_cases(edges, clashing, no_docs):
    for docs in (edges, clashing):
        rows = pr.find_runs(docs).collect()
        want = [brute_row(d, t, scramble=False) for d, t in EDGES if d not in (8, 9)]
        assert sorted((as_tuple(r) for r in rows if r.doc_id not in (8, 9)), key=repr) == sorted(want, key=repr)
        for r in rows:
            if r.doc_id in (8, 9):  # one sentence of eight words, 3,000 times
                assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (1, 0, 24_000, 8, 3_000_000)
                assert r.collapsed == "long words follow one another without an end" and len(r.runs) == 1
    assert pr.find_runs(no_docs).count() == 0
    assert pr.repeat_tail(None, []) == []
