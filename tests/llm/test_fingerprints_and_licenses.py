import hashlib

import numpy as np
import pytest

import brute
from conftest import EDGES
from dyadspark.llm import license_scan as ls, winnowing as w
from dyadspark.llm.hashing import text_slices
from dyadspark.llm.queries import QUERIES


@pytest.mark.parametrize("text", ["", "a", "ab" * 40, "a" * 100, "the quick brown fox jumps over the lazy dog " * 5, "日本語😀" * 30])
@pytest.mark.parametrize("k, window", [(4, 1), (4, 5), (16, 32)])
def test_winnow_is_rightmost_minimum_of_each_window(text, k, window):
    hashes, at = w.winnow(text, k, window)
    want = brute.winnow(text, w.rolling_hashes(text, k).tolist(), window)
    assert list(zip(hashes.tolist(), at.tolist())) == want


def test_shared_runs_share_a_fingerprint():
    passage = "a passage of more than forty-seven characters, word for word"
    a, _ = w.winnow("one text before " + passage + " and one text after", 16, 32)
    b, _ = w.winnow("quite another beginning: " + passage, 16, 32)
    assert set(a.tolist()) & set(b.tolist())


def expected(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for i, (d, t) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        f, g, h = (w.winnow(x, 16, 32)[0] for x in (t, edited, following))
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), w.as_text(f), w.as_text(g),
                    w.likeness(f, g), w.likeness(f, h)))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)
                   for r in df.collect()), key=str)


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_edits_against_the_next_row(corpus, corpus_rows, parts):
    assert rows_of(w.compare_with_edits(corpus, parts)) == expected(corpus_rows)


def test_fingerprints_of_edge_cases(edges, clashing, no_docs, make):
    for docs in (edges, clashing):
        assert rows_of(w.compare_with_edits(docs, 4)) == expected(EDGES)
        found = {(str(r.doc_id), r.fingerprint, len(r.positions)) for r in w.fingerprints(docs).collect()}
        assert ("1", "", 0) in found and ("2", "", 0) in found
    assert w.compare_with_edits(no_docs, 4).collect() == []
    only = w.compare_with_edits(make([(5, "a single row is its own next row")]), 4).collect()
    assert only[0].near_next == 1.0


def test_equal_texts_have_equal_fingerprints(edges):
    prints = {}
    for r in w.fingerprints(edges).collect():
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[8] == prints[9] and prints[6] < prints[7]


def brute_scan(rows, threshold=0.75):
    """Every template against every document, without retrieval."""
    import pyarrow as pa

    out = []
    for d, text in rows:
        for _, data, offsets in text_slices(pa.array([text], pa.string())):
            s = ls.Shingles(data, offsets)
            for t in map(lambda x: ls.Template(*x), ls.TEMPLATES):
                for a, b, share in ls.occurrences(s.hash, t.shingles, threshold) if len(s.hash) else []:
                    raw = data.tobytes()
                    out.append((d, t.name, round(share, 9), len(raw[: s.start[a]].decode()), len(raw[: s.end[b]].decode())))
    return sorted(out, key=str)


def scanned(df):
    return sorted(((r.doc_id, r.template, round(r.containment, 9), r.start, r.end) for r in df.collect()), key=str)


def test_scan_equals_brute_force(spark, folder, corpus_rows):
    got = scanned(QUERIES["op5_license_scan"](spark, folder))
    assert got == brute_scan(corpus_rows) and got


def test_scan_finds_edited_templates(make):
    grant = next(t for _, n, t in ls.TEMPLATES if n == "mit-grant")
    words = grant.split()
    edited = " ".join(words[:30] + ["altered"] + words[31:])
    filler = " ".join(f"w{i}" for i in range(300))
    rows = [(1, f"{filler} {edited} {filler}"), (2, grant.upper().replace(" ", "\n * ")), (3, " ".join(words[:20])), (4, filler)]
    got = ls.scan(make(rows)).collect()
    assert sorted((r.doc_id, r.template) for r in got) == [(1, "mit-grant"), (2, "mit-grant")]
    first = next(r for r in got if r.doc_id == 1)
    assert rows[0][1][first.start : first.end].startswith("Permission is hereby")


def test_scan_of_edge_cases(edges, clashing, no_docs, make):
    line = ls.TEMPLATES[0][2]
    assert ls.scan(edges).collect() == [] and ls.scan(clashing).collect() == [] and ls.scan(no_docs).collect() == []
    twice = ls.scan(make([(1, f"{line}\n{line}"), (1, line), (None, line)])).collect()
    assert sorted(str(r.doc_id) for r in twice) == ["1", "1", "1", "None"]


def test_bands_keep_their_promise():
    for t in map(lambda x: ls.Template(*x), ls.TEMPLATES):
        n = len(t.shingles)
        step = max(1, t.window // 4)
        assert n + (step if step > 1 else 0) <= t.window and np.log(1e-4) > ls.BANDS * np.log(1 - 0.75 * n / (t.window + 0.25 * n))
