"""Exact ranks and running sums; no task grows with one frequent or one outlying value."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadspark.operators import community, figures, ranking, relational as rel


@pytest.fixture(scope="module")
def outlying(spark):
    """Half of the rows hold one value of one class, and one value lies far out."""
    return spark.range(4000).selectExpr(
        "if(id % 2 = 0, 7, id) as v", "if(id % 3 = 0, null, 'g') as g", "id").unionByName(
        spark.createDataFrame([(10**12, "g", 4000)], "v long, g string, id long"))


def test_ranks_follow_the_order(outlying):
    rows = ranking.ranked(outlying, F.col("g").asc_nulls_first(), "v", "id").orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(4001))
    keys = [(r.g is not None, r.g or "", r.v, r.id) for r in rows]
    assert keys == sorted(keys)
    assert ranking.ranked(outlying.where("false"), "v").count() == 0


def test_running_sums(outlying):
    rows = ranking.running_sum(outlying.withColumn("w", F.col("id") % 5), "w", "v", "id").orderBy("v", "id").collect()
    total = 0
    for r in rows:
        assert r.before == total
        total += r.w


def test_dense_ids_with_an_outlying_key(outlying):
    ids = rel.dense_id(outlying.withColumn("b", F.col("id") % 3), ("v", "b"), "d").collect()
    place = {k: i + 1 for i, k in enumerate(sorted({(r.v, r.b) for r in ids}))}
    assert len(ids) == 4001 and all(place[r.v, r.b] == r.d for r in ids)


def test_quantiles_with_an_outlying_value(outlying):
    got = {r.g: r for r in figures.quantiles(outlying, "v", "g", {"q1": 0.25, "q3": 0.9, "last": 1.0}).collect()}
    by = {}
    for r in outlying.collect():
        by.setdefault(r.g, []).append(float(r.v))
    for g, values in by.items():
        assert [got[g].q1, got[g].q3, got[g]["last"]] == pytest.approx(list(np.quantile(values, [0.25, 0.9, 1.0])))


def test_rarefying_lists_a_large_count_in_runs(spark, monkeypatch):
    counts = spark.createDataFrame([("s", "a", 50_000), ("s", "b", 30_000), ("t", "a", 3)], "sample_id string, taxon_id string, n long")
    want = {(r.sample_id, r.taxon_id): r.n for r in community.rarefy(counts, 1000).collect()}
    monkeypatch.setattr(community, "_RUN", 1000)
    monkeypatch.setattr(community, "_SLICE", 16)  # four leading digits instead of two
    got = {(r.sample_id, r.taxon_id): r.n for r in community.rarefy(counts, 1000).collect()}
    assert got == want and sum(got.values()) == 1000 and {s for s, _ in got} == {"s"}
    assert got["s", "a"] == pytest.approx(625, abs=80)
