"""Community operators against direct computation and their defining properties."""

import hashlib
import math
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadspark.operators import community, distance
from dyadspark.operators.relational import count_by


@pytest.fixture(scope="module")
def counts():
    rng = np.random.default_rng(3)
    table = rng.negative_binomial(1, 0.02, size=(30, 40)) * (rng.random((30, 40)) < 0.6)
    table[5] = table[4]
    return table


@pytest.fixture(scope="module")
def abundance(spark, counts):
    cells = [(int(i), f"t{j:02d}", int(n)) for (i, j), n in np.ndenumerate(counts) if n > 0]
    return spark.createDataFrame(cells, "sample_id bigint, taxon_id string, n bigint").cache()


def clr(table, policy):
    share = table / table.sum(1, keepdims=True)
    half = share[share > 0].min() / 2
    logs = np.log(share + half) if policy == "shift_all" else np.log(np.where(share > 0, share, half))
    return logs - logs.mean(1, keepdims=True)


@pytest.mark.parametrize("policy", ["shift_all", "replace_zero"])
def test_log_ratio_and_all_distance_forms(spark, abundance, counts, policy):
    want = clr(counts[:, counts.sum(0) > 0].astype(float), policy)
    ratios = community.log_ratio(abundance, policy).cache()
    per_sample = ratios.groupBy("sample_id").agg(
        F.sum("clr").alias("s"), F.count(F.lit(1)).alias("k"), F.min("clr_absent").alias("a")
    ).collect()
    for r in per_sample:  # centred: present and absent taxa together sum to zero
        assert r.s + (want.shape[1] - r.k) * r.a == pytest.approx(0, abs=1e-9)
    samples = spark.range(30).selectExpr("id as sample_id", "id as ord", "id % 2 as block")
    exact = {
        (i, j): float(np.linalg.norm(want[i] - want[j])) for i, j in combinations(range(30), 2) if i % 2 == j % 2
    }
    arrays = distance.aitchison_pairs(ratios, samples, ["block"], tile_rows=4)
    tiles = distance.distance_tiles(ratios, samples, ["block"], tile_rows=4)
    long = distance.distance_long(ratios, arrays.select("sample_id_x", "sample_id_y"))
    for form in (arrays, tiles, long):
        got = {(r.sample_id_x, r.sample_id_y): r.distance for r in form.collect()}
        assert got.keys() == exact.keys()
        assert all(got[k] == pytest.approx(v, abs=1e-7) for k, v in exact.items())


def test_coinciding_samples_are_dropped_on_request(spark, abundance):
    ratios = community.log_ratio(abundance)
    samples = spark.range(30).selectExpr("id as sample_id", "id as ord", "0 as block")
    pairs = distance.aitchison_pairs(ratios, samples, ["block"])
    kept = distance.similarity(pairs).count()
    assert distance.similarity(pairs, drop_zero=False).count() == kept + 1 == 435


def test_distance_ignores_depth_without_zeros(spark):
    cells = [(s, f"t{t}", (t + 1) * (10 if s else 1)) for s in (0, 1) for t in range(5)]
    abundance = spark.createDataFrame(cells, "sample_id bigint, taxon_id string, n bigint")
    ratios = community.log_ratio(abundance, "replace_zero")
    samples = spark.range(2).selectExpr("id as sample_id", "id as ord", "0 as block")
    assert distance.aitchison_pairs(ratios, samples, ["block"]).first()["distance"] == pytest.approx(0, abs=1e-7)


def test_core_taxa_count_all_samples(spark, abundance, counts):
    share = counts / counts.sum(1, keepdims=True)
    want = {f"t{j:02d}" for j in range(40) if (share[:, j] > 0.01).mean() > 0.4}
    got = {r.taxon_id for r in community.core_taxa(community.relative_abundance(abundance), 0.01, 0.4).collect()}
    assert got == want and 0 < len(want) < 40


@pytest.mark.parametrize("method", [community.rarefy, community.rarefy_deep])
def test_rarefaction_depth(abundance, counts, method):
    depth = 700
    drawn = method(abundance, depth).cache()
    totals = {r.sample_id: r.t for r in drawn.groupBy("sample_id").agg(F.sum("n").alias("t")).collect()}
    assert totals == {i: depth for i in range(30) if counts[i].sum() >= depth} and 0 < len(totals) < 30
    assert all(r.n <= counts[r.sample_id, int(r.taxon_id[1:])] for r in drawn.collect())
    again = {tuple(r) for r in method(abundance.repartition(3), depth).collect()}
    assert again == {tuple(r) for r in drawn.collect()}


def test_rarefaction_in_buckets_is_unbiased(spark):
    cells = [(s, f"t{t}", 20 * (t + 1)) for s in range(200) for t in range(6)]
    abundance = spark.createDataFrame(cells, "sample_id bigint, taxon_id string, n bigint")
    drawn = community.rarefy_deep(abundance, 84, bucket_taxa=2)
    mean = {r.taxon_id: r.m / 200 for r in drawn.groupBy("taxon_id").agg(F.sum("n").alias("m")).collect()}
    for t in range(6):
        assert mean[f"t{t}"] == pytest.approx(4 * (t + 1), abs=0.8)


def test_alpha_diversity(abundance, counts):
    for r in community.alpha_diversity(abundance).collect():
        n = counts[r.sample_id][counts[r.sample_id] > 0]
        p = n / n.sum()
        f1, f2 = (n == 1).sum(), (n == 2).sum()
        assert r.observed == len(n)
        assert r.shannon == pytest.approx(-(p * np.log(p)).sum())
        assert r.chao1 == pytest.approx(len(n) + f1 * (f1 - 1) / (2 * (f2 + 1)))


def test_agglomerate_and_profile(spark, abundance, counts):
    labels = [(f"t{j:02d}", f"f{j % 3}", None if j % 10 == 9 else f"g{j % 4}") for j in range(40)]
    taxonomy = spark.createDataFrame(labels, "taxon_id string, family string, genus string")
    merged, groups = community.agglomerate(abundance, taxonomy, ["family", "genus"])
    assert merged.agg(F.sum("n")).first()[0] == sum(counts[:, j].sum() for j in range(40) if j % 10 != 9)
    assert groups.count() == len({(f, g) for _, f, g in labels if g})
    assert count_by(merged, "sample_id", "taxon_id").where("n > 1").count() == 0
    classes = spark.createDataFrame([("g0", "A"), ("g1", "B"), ("g2", "A")], "genus string, class string")
    profile = community.functional_profile(abundance, taxonomy, classes, ["family", "genus"])
    sums = profile.groupBy("sample_id").agg(F.sum("sum_clr").alias("s"), F.count(F.lit(1)).alias("k")).collect()
    assert all(abs(r.s) < 1e-9 and r.k == 3 for r in sums)


def test_pairs_of_one_hot_block_are_complete(spark):
    rows = spark.range(300).selectExpr("if(id % 3 = 0, 0, id % 20 + 1) as block", "id as ord")
    blocks = {}
    for i in range(300):
        blocks.setdefault(0 if i % 3 == 0 else i % 20 + 1, []).append(i)
    want = {(b, i, j) for b, v in blocks.items() for i, j in combinations(v, 2)}
    pairs = distance.pair_within(rows, ["block"], "ord", tile_rows=7).collect()
    assert len(pairs) == len(want)
    assert {(r.block, r.ord_x, r.ord_y) for r in pairs} == want
    assert distance.pair_within(rows, [], "ord", tile_rows=50).count() == math.comb(300, 2)


def drawn_by_hand(rows, depth, seed=88):
    """The draw read by read: the smallest MD5 hex strings of each sample."""
    tickets = defaultdict(list)
    for sample, taxon, n in rows:
        for i in range(1, (n or 0) + 1):
            text = "|".join(str(v) for v in (seed, sample, taxon, i) if v is not None)
            tickets[sample].append((hashlib.md5(text.encode()).hexdigest(), taxon))
    out = Counter()
    for sample, own in tickets.items():
        if sample is not None and len(own) >= depth:
            out.update((sample, taxon) for _, taxon in sorted(own, key=lambda t: t[0])[:depth])
    return out


@pytest.mark.parametrize("task", [1 << 18, 500])
def test_rarefaction_equals_a_draw_read_by_read(spark, monkeypatch, task):
    # texts of one, two and three MD5 blocks, taxa in several rows or without a name, counts of 0 or missing; large samples in runs
    monkeypatch.setattr(community, "_TASK", task)
    monkeypatch.setattr(community, "_RUN", 64)
    rng = np.random.default_rng(1)
    names = ["a", "b" * 46, "c" * 47, "d" * 55, "e" * 70, "f" * 130, "\u00e4\u00f6", None]
    rows = [(s, names[rng.integers(8)], int(rng.integers(0, 120))) for s in range(1, 40) for _ in range(int(rng.integers(1, 14)))]
    rows += [(77, "a", 100), (77, "g", 1000), (78, "a", 99), (79, "a", 60), (79, "b", 40), (None, "a", 500), (80, "a", None)]
    df = spark.createDataFrame(rows, "sample_id bigint, taxon_id string, n bigint").repartition(5)
    got = {(r.sample_id, r.taxon_id): r.n for r in community.rarefy(df, 100).collect()}
    assert got == dict(drawn_by_hand(rows, 100))


def test_rarefaction_makes_no_row_of_a_read(abundance):
    plan = community.rarefy(abundance, 60)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "md5" not in plan


def test_subset_alpha_hands_no_read_to_a_shuffle(spark, folder):
    import __spark_entry__

    # rarefaction's part of the plan: nothing below it lists reads
    plan = __spark_entry__.queries()["k12_subset_alpha"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
