"""Repeats that must go whole: lines of any length, passages wherever they stand."""

import random

import brute
from dyadspark.llm import unit_dedup as ud
from dyadspark.llm.queries import QUERIES


def cut(df):
    return {r.doc_id: (r.text, [(s.start, s.end) for s in r.removed]) for r in df.collect()}


def lines(text):
    """(normalised words, start, end) in code points of the lines that have words."""
    at, out = 0, []
    for line in (text or "").split("\n"):
        found = list(brute.WORD.finditer(line))
        if found:
            out.append((tuple(brute.lower(m[0]) for m in found), at + found[0].start(), at + found[-1].end()))
        at += len(line) + 1
    return out


def test_short_line_of_many_documents_is_kept_once(make):
    rows = [(i, f"Own line {i} opens text {i * 7} here\nShare this  page\nOwn line {i} ends text {i * 3} here\n") for i in range(2, 300)]
    rows[5] = (7, rows[5][1].replace("Share this  page", "SHARE this page"))
    got = cut(ud.dedup_units(make(rows)))
    assert got[2] == (rows[0][1], [])
    for d, t in rows[1:]:
        first, _, last, _ = t.split("\n")
        assert got[d] == (f"{first}\n{last}\n", [(len(first) + 1, len(t) - len(last) - 1)])


def test_short_line_is_told_from_a_sentence_inside_a_line(make):
    rows = [(1, "Yes. A sentence that no other text has."), (2, "Yes.\nnot in any other text"), (3, "Yes.\nYes.\nown words of this text")]
    got = cut(ud.dedup_units(make(rows)))
    assert [got[d][0] for d in (1, 2, 3)] == [rows[0][1], rows[1][1], "own words of this text"]


def test_no_later_whole_line_of_the_corpus_stays(spark, folder, corpus_rows):
    got = cut(QUERIES["op7_substring_dedup"](spark, folder))
    seen, short = set(), 0
    for d, text in sorted(corpus_rows):
        for line, a, b in lines(text):
            if line in seen:
                assert any(s <= a and b <= e for s, e in got[d][1])
                short += len(line) < 10
            seen.add(line)
        kept = text or ""
        for s, e in reversed(got[d][1]):
            kept = kept[:s] + kept[e:]
        assert got[d][0] == (None if text is None else kept)
    assert short


def test_passage_without_sentence_ends_is_cut_inside_lines(make):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    for length in (51, 60, 120):
        passage = " ".join(word() for _ in range(length))
        texts = [(" ".join(word() for _ in range(150)), " ".join(word() for _ in range(150))) for _ in range(40)]
        rows = [(i, f"{a} {passage} {b}.") for i, (a, b) in enumerate(texts)]
        got = cut(ud.dedup_units(make(rows)))
        assert got[0] == (rows[0][1], [])
        for d, t in rows[1:]:
            a, b = texts[d]
            assert got[d][0].startswith(a) and got[d][0].endswith(f"{b}.")
            assert len(got[d][0].split()) - 300 <= 20


def test_words_a_chain_shares_with_a_next_sentence_stay(make):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"Own start {i} ends so. {passage} last. And own {i} goes on.") for i in range(2, 30)]
    got = cut(ud.dedup_units(make(rows)))
    for d, t in rows[1:]:
        assert got[d][0] == f"Own start {d} ends so. And own {d} goes on."
