"""Test items of which many edited or partial copies stand in the documents."""

import random

import pytest

import brute
from dyadspark.llm import decontaminate as dc


def scores(df):
    return {(r.doc_id, r.item_id): r.score for r in df.collect()}


@pytest.mark.parametrize("partial", [False, True])
def test_a_hundred_copies_of_an_edited_item_are_found(spark, make, partial):
    rng = random.Random(8)
    item = [f"q{i}" for i in range(60)]
    copy = item[:40] if partial else [f"edit{i}" if i in (9, 23, 37, 51) else w for i, w in enumerate(item)]
    filler = lambda n: [f"f{rng.randrange(10 ** 6)}" for _ in range(n)]
    rows = [(i, filler(30) + (copy if i < 100 else []) + filler(30)) for i in range(1000)]
    got = scores(dc.leaks(make([(d, " ".join(w)) for d, w in rows]), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")))
    want = brute.smith_waterman(item, rows[0][1]) / 120
    assert got == {(d, 1): pytest.approx(want) for d in range(100)}


def test_copies_that_hold_other_parts_are_found_beside_rare_ones(spark, make):
    item = [f"q{i}" for i in range(60)]
    rows = [(i, " ".join(item[:35] + [f"own{i}"])) for i in range(60)] + [(i, " ".join(item[20:] + [f"own{i}"])) for i in range(60, 65)]
    got = scores(dc.leaks(make(rows), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")))
    assert got == {(d, 1): pytest.approx(35 / 60 if d < 60 else 40 / 60) for d in range(65)}
