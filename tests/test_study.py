"""Genetics, figures, roster, dyads, annotation and file formats."""

import datetime
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dyadspark.operators import annotate, community, dyads, figures, genetics, roster
from dyadspark.plans import pair_similarity as plan
from dyadspark.sources import readers, writers


# ---- genetics ----


@pytest.fixture(scope="module")
def genotypes(spark):
    rng = np.random.default_rng(2)
    rows = []
    for ind in range(12):
        for locus in range(6):
            if rng.random() < 0.85:
                rows.append((ind, f"L{locus}", *(int(a) for a in rng.integers(1, 4, 2))))
            else:
                rows.append((ind, f"L{locus}", None, None))
    rows += [(12, r[1], r[2], r[3]) for r in rows if r[0] == 0]
    return rows, spark.createDataFrame(rows, "ind bigint, locus string, a int, b int").cache()


def test_relatedness_against_direct_sums(spark, genotypes):
    rows, df = genotypes
    freq, total = {}, {}
    for _, locus, *alleles in rows:
        for a in alleles:
            if a is not None:
                freq[locus, a] = freq.get((locus, a), 0) + 1
                total[locus] = total.get(locus, 0) + 1
    p = {k: v / total[k[0]] for k, v in freq.items()}
    by = {}
    for ind, locus, a, b in rows:
        if a is not None:
            by.setdefault(ind, {})[locus] = (a, b)

    def one_way(x, y):
        num = den = 0.0
        for locus in x.keys() & y.keys():
            (a, b), (c, d) = x[locus], y[locus]
            q = p[locus, a] + p[locus, b]
            num += 0.5 * ((a == c) + (a == d) + (b == c) + (b == d)) - q
            den += 1 + (a == b) - q
        return num, den

    want_mean, want_pool = {}, {}
    for i, j in combinations(sorted(by), 2):
        (nx, dx), (ny, dy) = one_way(by[i], by[j]), one_way(by[j], by[i])
        want_mean[i, j], want_pool[i, j] = (nx / dx + ny / dy) / 2, (nx + ny) / (dx + dy)
    blocks = df.select("ind", F.lit(1).alias("block")).distinct()
    terms = genetics.relatedness_terms(df, blocks, ["block"], tile_rows=4).cache()
    for pooling, want in (("mean", want_mean), ("pooled", want_pool)):
        got = {(r.ind_x, r.ind_y): r.relatedness for r in genetics.relatedness(terms, pooling).collect()}
        assert got.keys() == want.keys()
        assert all(got[k] == pytest.approx(v) for k, v in want.items())
    limits = genetics.relatedness_limits(terms, 60).collect()
    assert all(r.lower <= r.upper for r in limits)
    assert want_mean[0, 12] > 0.4  # the copy of an individual


# ---- figures ----


def test_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(4)
    values = {"a": np.concatenate([np.full(400, 2.5), rng.normal(0, 3, 801)]), "b": rng.integers(0, 9, 10).astype(float), "c": np.array([7.0])}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in figures.quantiles(df, "v", "g", {"q1": 0.25, "q2": 0.5, "q3": 0.75}).collect()}
    for k, vs in values.items():
        assert [got[k].q1, got[k].q2, got[k].q3] == pytest.approx(list(np.quantile(vs, [0.25, 0.5, 0.75])))
    box = {r.g: r for r in figures.box_stats(df, "v", "g").collect()}
    q1, q3 = np.quantile(values["a"], [0.25, 0.75])
    inside = values["a"][(values["a"] >= q1 - 1.5 * (q3 - q1)) & (values["a"] <= q3 + 1.5 * (q3 - q1))]
    assert box["a"].upper_whisker == pytest.approx(inside.max()) and box["a"].outliers == len(values["a"]) - len(inside)


def test_histogram_and_density(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(10, 2, 2000)
    df = spark.createDataFrame([("k", float(x)) for x in v], "g string, v double")
    hist = {r.bin: r.n for r in figures.histogram(df, "v").collect()}
    want, _ = np.histogram(v, 30)
    assert hist == {i: int(n) for i, n in enumerate(want)} and 0 in hist.values()
    grid = sorted((r.at, r.density) for r in figures.density(df, "v", "g").collect())
    area = np.trapezoid([d for _, d in grid], [a for a, _ in grid])
    assert len(grid) == 64 and area == pytest.approx(1, abs=0.05)
    q1, q3 = np.quantile(v, [0.25, 0.75])
    width = 0.45 * min(v.std(ddof=1), (q3 - q1) / 1.34) * len(v) ** -0.2
    middle = grid[32]
    exact = np.exp(-0.5 * ((middle[0] - v) / width) ** 2).sum() / (len(v) * width * np.sqrt(2 * np.pi))
    assert middle[1] == pytest.approx(exact, rel=1e-2)


def test_small_classes_keep_their_rows(spark):
    df = spark.createDataFrame([("one", 3.0), ("same", 4.0), ("same", 4.0), ("two", 1.0), ("two", 9.0)], "g string, v double")
    rows = figures.density(df, "v", "g").collect()
    by = {g: [r.density for r in rows if r.g == g] for g in ("one", "same", "two")}
    assert {g: len(d) for g, d in by.items()} == {"one": 64, "same": 64, "two": 64}
    assert set(by["one"]) == {None} and all(d > 0 for d in by["same"] + by["two"])
    bins = figures.histogram(df, "v", 4, ["g"]).collect()
    assert len(bins) == 12 and sum(r.n for r in bins) == 5


# ---- roster and dyads ----


def test_best_role_precedes_the_role_filter(spark):
    status = spark.createDataFrame(
        [(1, 10, "SEEN1", 1), (2, 10, "BrU", 2), (1, 11, "AB", 3), (2, 11, "H", 4), (3, 12, "SEEN2", 5)],
        "group_id bigint, bird_id bigint, role string, status_id bigint")
    groups = spark.createDataFrame([(1, 5, 100), (2, 5, 101), (3, 5, 102)], "group_id bigint, period_id bigint, territory_id bigint")
    best = roster.best_roles(status, groups).collect()
    assert [(r.bird_id, r.role, r.group_id) for r in best] == [(11, "H", 2)]


def test_tenure_counts_records_of_a_breeding_pair(spark):
    rows = [(g, b, r) for g, m, f in ((1, 5, 6), (2, 5, 6), (3, 5, 7), (4, 5, 6), (5, 0, 6), (6, 5, None)) for b, r in ((m, "BrM"), (f, "BrF")) if b is not None]
    best = spark.createDataFrame([(g, 1, 9, b, r) for g, b, r in rows], "group_id bigint, period_id bigint, territory_id bigint, bird_id bigint, role string")
    got = {r.group_id: r.seasons_together for r in roster.group_dimension(best).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 3, 5: 0, 6: 0}


def test_parent_is_the_first_confident_row(spark):
    rows = [(1, 50, 7, 90.0, 1), (1, 51, 7, 99.0, 0), (2, None, 7, 95.0, 2), (2, 52, 7, 96.0, 3), (3, 53, 7, 80.0, 4)]
    df = spark.createDataFrame(rows, "off_id bigint, parent bigint, spouse_id bigint, confidence double, file_row bigint")
    assert [(r.off_id, r.parent) for r in roster.genetic_parents(df).collect()] == [(1, 51)]


def test_pair_type_does_not_depend_on_order(spark):
    roles = dyads.PAIRABLE_ROLES
    rows = [(a, b, rel) for a in roles for b in roles for rel in ("sameGroup", "diffGroup", "sameBird")]
    df = spark.createDataFrame(rows, "role_x string, role_y string, relation string")
    got = {(r.role_x, r.role_y, r.relation): r.t for r in df.select("*", dyads.pair_type().alias("t")).collect()}
    assert all(got[a, b, rel] == got[b, a, rel] for a, b, rel in rows)
    assert got["BrM", "BrF", "sameGroup"] == "Dominantpair" and got["ABX", "H", "sameGroup"] == "HelpSub"
    assert got["H", "H", "sameGroup"] == "SubSub" and got["OFL", "BrM", "sameGroup"] == "sameTerrothers"
    assert got["OFL", "BrM", "diffGroup"] == "diffGroup"


def test_natal_rules(spark):
    base = {f"{c}_{e}": None for c in dyads.NATAL_COLUMNS for e in "xy"}
    schema = "bird_id_x bigint, bird_id_y bigint, " + ", ".join(f"{c} bigint" for c in base)

    def published(**hit):
        row = {"bird_id_x": 1, "bird_id_y": 2, **base, **hit}
        return spark.createDataFrame([tuple(row.values())], schema).select(dyads.shared_natal()).first()[0]

    assert published(H_3_x=2) == "same" and published(BrM_1_y=1) == "same" and published(BrF_2_y=2) == "same"
    assert published(H_1_y=1) == "different" and published() == "different"
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (4, 5), (None, 2)], "bird_a bigint, bird_b bigint")
    natal = spark.createDataFrame(
        [(1, 2), (1, 2), (5, 4), (3, 3), (2, None)], "bird_id bigint, attendant bigint")
    both = {(r.bird_a, r.bird_b): r.shared_natal for r in dyads.with_shared_natal(pairs, natal).collect()}
    assert both == {(1, 2): "same", (1, 3): "different", (2, 4): "different", (4, 5): "same", (None, 2): "different"}


def test_no_attendant_or_roster_bird_is_cut(spark):
    status = spark.createDataFrame(
        [(1, b, "H", b) for b in range(3, 9)] + [(1, 1, "BrM", 1), (1, 2, "BrF", 2), (1, 20, "OFL", 20), (2, 20, "AB", 30)],
        "group_id bigint, bird_id bigint, role string, status_id bigint")
    groups = spark.createDataFrame([(1, 1, 7), (2, 2, 8)], "group_id bigint, period_id bigint, territory_id bigint")
    natal = roster.natal_table(status, groups)
    mine = {(r.attendant_role, r.slot): r.attendant for r in natal.where("bird_id = 20").collect()}
    assert {v for (role, _), v in mine.items() if role == "H"} == set(range(3, 9)) and len(mine) == 8
    named = roster.natal_slots(natal).where("bird_id = 20").first()
    assert (named.H_1, named.H_3, named.BrM_1, named.BrF_2) == (3, 5, 1, None)
    best = roster.best_roles(status, groups)
    slots = {(r.group_id, r.role, r.slot): r.bird_id for r in roster.group_slots(best).collect()}
    assert slots[1, "H", 6] == 8 and slots[1, "BrM", 1] == 1 and len(slots) == 10
    wide = {r.group_id: r for r in roster.group_wide(roster.group_lists(best)).collect()}
    assert wide[1].H_6 == 8 and wide[1].H_n == 6 and wide[2].AB_1 == 20


def test_groups_without_a_pair_are_not_numbered(spark):
    status = spark.createDataFrame(
        [(g, 5, "BrM", g) for g in range(1, 40)] + [(g, 6, "BrF", 100 + g) for g in (3, 9, 30)],
        "group_id bigint, bird_id bigint, role string, status_id bigint")
    groups = spark.createDataFrame([(g, g, 1) for g in range(1, 40)], "group_id bigint, period_id bigint, territory_id bigint")
    dim = {r.group_id: r.seasons_together for r in roster.group_dimension(roster.best_roles(status, groups)).collect()}
    assert [dim[3], dim[9], dim[30]] == [1, 2, 3] and sum(dim.values()) == 6


def test_pair_counts_with_missing_groups(spark):
    rows = [(1, i, i, b, g, r) for i, (b, g, r) in enumerate(
        [(1, 1, "BrM"), (2, 1, "H"), (3, None, "H"), (4, 2, "BrM"), (4, None, "AB"), (5, None, "BrM"), (None, 1, "H"), (2, 1, "H")])]
    samples = spark.createDataFrame(
        rows, "year int, ord bigint, sample_id bigint, bird_id bigint, group_id bigint, role string")
    for c, kind in (("territory_id", "bigint"), ("catch_time", "bigint"), ("time_in_fridge", "bigint"), ("sample_date", "date"),
                    ("sampling_age", "double"), ("sex", "bigint"), ("season", "string")):
        samples = samples.withColumn(c, F.lit(None).cast(kind))
    pairs = plan.pair_table(samples, block=["year"])
    want = {(r.relation, r.pair_type): r.n for r in pairs.groupBy("relation", "pair_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    got = {(r.relation, r.pair_type): r.n for r in dyads.count_pairs(samples, ["year"]).collect()}
    assert got == want and (None, None) in got


def test_dyad_helpers(spark):
    df = spark.createDataFrame([(5, 3), (3, 5), (None, 2)], "bird_id_x bigint, bird_id_y bigint")
    assert {(r.bird_a, r.bird_b) for r in dyads.dyad_key(df).collect()} == {(3, 5), (None, None)}


# ---- annotation ----


def test_agreement_and_vocabulary(spark):
    rows = [("Aerobic", "mixed"), ("Anaerobic", "Anaerobe"), ("Facultatively anaerobic", "Aerobic"), (None, "unknown"), ("Unknown", "mixed")]
    df = spark.createDataFrame(rows, "label1 string, expert string")
    scored = df.select("*", annotate.conflict("label1", "expert", annotate.AGREE_MACHINE1_CURATOR).alias("c"))
    assert [r.c for r in scored.collect()] == ["0", "0", "1", "0", "1"]
    common = [r[0] for r in df.select(annotate.harmonise("label1", "machine1")).collect()]
    assert common == ["Aerotolerant", "Anaerobic", "Aerotolerant", "Unassigned", "Unknown"]


@pytest.mark.parametrize("required", [["l", "r"], ["l"], ["r"], []])
def test_narrowed_joins_equal_the_full_join(spark, required):
    a = spark.createDataFrame([(1, "a"), (2, None), (None, "c"), (5, "e")], "k int, l string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (None, None), (7, "z")], "k int, r string")
    full = annotate.merge_tables(a, b, ["k"], "full")
    for c in required:
        full = full.where(F.col(c).isNotNull())
    got = annotate.compare_sources(a, b, "k", "l", "r", [(["a"], ["x"])], "full", required)
    assert sorted(map(str, got.select("k", "l", "r").collect())) == sorted(map(str, full.select("k", "l", "r").collect()))


# ---- files ----


def test_text_formats(spark, tmp_path):
    text = tmp_path / "a.csv"
    text.write_bytes("﻿id,day,flag,v\r\n1, 03/02/2017 ,TRUE, 2.5\r\n2,NA,FALSE,\r\n3,nonsense,NA,x".encode())
    columns = [("id", "id", "bigint"), ("day", "day", "day"), ("flag", "flag", "flag"), ("v", "v", "double")]
    got = [tuple(r) for r in readers.read_csv(spark, str(text), columns).orderBy("id").collect()]
    assert got == [(1, datetime.date(2017, 2, 3), True, 2.5), (2, None, False, None), (3, None, None, None)]
    loci = ["L1", "L2"]
    (tmp_path / "g.txt").write_text("1 10 12 NA NA\n2 8 8 6 7\n")
    geno = readers.read_genotype_text(spark, str(tmp_path / "g.txt"), loci)
    assert {tuple(r) for r in geno.collect()} == {(1, "L1", 10, 12), (1, "L2", None, None), (2, "L1", 8, 8), (2, "L2", 6, 7)}
    (tmp_path / "c.tsv").write_text("taxon\ts1\ts2\nt1\t3\t0\nt2\t0\t5\n")
    counts = readers.read_wide_counts(spark, str(tmp_path / "c.tsv"), "taxon", ["s1", "s2"])
    assert {tuple(r) for r in counts.collect()} == {("s1", "t1", 3), ("s2", "t2", 5)}
    writers.write_tsv(counts, str(tmp_path / "out"))
    back = readers.read_tsv(spark, str(tmp_path / "out"), [("sample_id", "sample_id", "string"), ("taxon_id", "taxon_id", "string"), ("n", "n", "bigint")])
    assert back.count() == 2


def test_pair_table_store(spark, tmp_path):
    pairs = spark.range(100).selectExpr("id as sample_id_x", "id + 1 as sample_id_y", "2000 + id % 2 as year", "'Major' as season", "'DomSub' as pair_type")
    writers.write_pair_table(pairs, str(tmp_path / "pairs"))
    back = writers.read_pair_table(spark, str(tmp_path / "pairs"), {"pair_type": dyads.PAIR_TYPES})
    assert back.where("year = 2000").count() == 50 and back.first()["pair_type_rank"] == 4
    plan_text = back.where("year = 2000")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan_text


# ---- plans ----


def test_pairs_need_no_shuffle_after_they_are_made(spark):
    samples = spark.range(60).selectExpr(
        "id as sample_id", "id as ord", "id % 20 as bird_id", "id % 6 as group_id", "id % 6 as territory_id", "2000 + id % 2 as year", "if(id % 3 = 0, 'Major', 'Minor') as season",
        "element_at(array('BrM','BrF','H','AB','CH'), int(id % 5) + 1) as role", "id as catch_time", "id as time_in_fridge",
        "date'2020-01-01' as sample_date", "double(id) as sampling_age", "id % 2 as sex")
    pairs = plan.pair_table(samples)
    text = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    last_join = min(i for i in (text.find("SortMergeJoin"), text.find("BroadcastHashJoin"), text.find("ShuffledHashJoin")) if i >= 0)
    assert "Exchange" not in text[:last_join]
    rows = pairs.collect()
    assert rows and all(r.bird_id_x != r.bird_id_y and r.role_x != "CH" and r.sample_id_x < r.sample_id_y for r in rows)


def test_pair_counts_without_pairs(spark):
    roles = dyads.PAIRABLE_ROLES
    samples = spark.range(400).selectExpr(
        "id as sample_id", "id as ord", "if(id % 3 = 0, 1, id % 60) as bird_id", "id % 11 as group_id", "id % 11 as territory_id",
        "2000 + id % 2 as year", "if(id % 5 = 0, 'Major', 'Minor') as season",
        f"element_at(array({', '.join(repr(r) for r in [*roles, 'CH'])}), int(pmod(hash(id), {len(roles) + 1})) + 1) as role",
        "id as catch_time", "id as time_in_fridge", "date'2020-01-01' as sample_date", "double(id) as sampling_age", "id % 2 as sex")
    keys = ["year", "season", "relation", "pair_type"]
    made = {tuple(r) for r in plan.pair_table(samples).groupBy(*keys).count().collect()}
    counted = {tuple(r) for r in dyads.count_pairs(samples, plan.BLOCK).select(*keys, "n").collect()}
    assert made == counted and made


@pytest.mark.parametrize("name, tables", [
    ("y1_metadata_and_alpha", 1), ("y12_alpha_similarity", 1), ("y24_aerobic_pairs", 2), ("y25_anaerobic_pairs", 2),
    ("model_anaerobic_interaction_means", 2)])
def test_alpha_of_pairs_puts_no_reads_on_disk(spark, folder, monkeypatch, name, tables):
    # rarefaction used to write a row per read and ticket; what is written now has a row per order, at most
    import __spark_entry__
    from dyadspark.operators import community
    from dyadspark.plans import pair_similarity

    written = []

    def watched(df, write=pair_similarity.materialise):
        written.append((out := write(df)).columns)
        return out

    monkeypatch.setattr(community, "materialise", watched, raising=False)
    monkeypatch.setattr(pair_similarity, "materialise", watched)
    __spark_entry__.queries()[name](spark, folder)
    assert len(written) == tables and all("sample_id" in c and "edge" not in c for c in written)
