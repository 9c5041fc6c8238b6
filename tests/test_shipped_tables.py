"""Expected values on the study's own tables, when a folder with them is named in DYADSPARK_TABLES.

Tables are told apart by their header, not by file name.
"""

import glob
import os

import pytest
from pyspark.sql import functions as F

from dyadspark.functions import days_apart
from dyadspark.functions.aggregates import summarise_columns
from dyadspark.operators import annotate, dyads, roster
from dyadspark.operators.relational import distinct_at_ends, merge_tables
from dyadspark.operators.distance import pair_within
from dyadspark.plans import pair_similarity as plan
from dyadspark.sources import read_annotation, read_sample_metadata

FOLDER = os.environ.get("DYADSPARK_TABLES")
pytestmark = pytest.mark.skipif(not FOLDER, reason="DYADSPARK_TABLES is not set")


def find(*header):
    for path in glob.glob(f"{FOLDER}/*"):
        with open(path, encoding="utf-8-sig") as f:
            first = f.readline().strip().replace("\t", ",").split(",")
        if first[: len(header)] == list(header):
            return path
    raise FileNotFoundError(header)


@pytest.fixture(scope="module")
def samples(spark):
    return read_sample_metadata(spark, find("SampleID", ".sample")).cache()


@pytest.fixture(scope="module")
def machine(spark):
    path = find("Genus", "Oxygen")
    return read_annotation(spark, path, ["genus", "label1", "spores"]).cache()


@pytest.fixture(scope="module")
def curator(spark):
    path = find("Genus", "Aerotolerance")
    return read_annotation(spark, path, ["genus", "expert", "spores", "reference", "indirect", "comments"]).cache()


def test_metadata_invariants(samples):
    assert samples.count() == 60
    bad = samples.where(
        (days_apart("freezer_date", "sample_date") != F.col("time_in_fridge"))
        | (days_apart("sample_date", "birth_date") != F.col("age_days"))
        | (F.abs(F.round(F.col("age_days") / 365.25, 3) - F.col("sampling_age")) > 1e-9)
        | (F.col("territory_id") != F.col("breed_territory_id"))
        | (F.abs(F.coalesce("tq", "tq_avg") - F.col("tq_final")) > 1e-9)
        | ((F.col("terminal_year") == "yes") != (F.col("years_to_last_seen") < 1))
    )
    assert bad.count() == 0
    assert samples.where("tq is null").count() == 3 and samples.where("catch_id is null").count() == 1
    assert {r.role: r["count"] for r in samples.groupBy("role").count().collect()}["BrF"] == 18


def test_pairs(samples):
    cols = ["year", "season", "ord", "sample_id", "bird_id", "group_id", "territory_id", "role", "catch_time",
            "time_in_fridge", "sample_date", "sampling_age", "sex"]
    slim = samples.select(*cols)
    everything = dyads.with_relations(pair_within(slim, ["year", "season"], "ord"))
    sizes = {r.relation: r["count"] for r in everything.groupBy("relation").count().collect()}
    assert sizes == {"diffGroup": 1728, "sameGroup": 29, "sameBird": 13}
    pairs = plan.pair_table(slim).cache()
    types = {r.pair_type: r["count"] for r in pairs.groupBy("pair_type").count().collect()}
    assert types == {"diffGroup": 1613, "DomHelp": 11, "HelpSub": 7, "DomSub": 5, "Dominantpair": 2}
    assert pairs.count() == 1638
    assert distinct_at_ends(pairs, ["sample_id_x", "sample_id_y"]).first()[0] == 58
    assert distinct_at_ends(pairs, ["bird_id_x", "bird_id_y"]).first()[0] == 46
    assert pairs.select("bird_a", "bird_b").distinct().count() == 1034
    s = summarise_columns(pairs, ["age_diff", "fridge_diff", "sample_date_diff", "catch_time_diff"]).first()
    assert (s.age_diff_min, s.age_diff_max) == pytest.approx((0.0, 13.648))
    assert (s.age_diff_mean, s.age_diff_sd) == pytest.approx((3.151636, 3.038215), abs=1e-6)
    assert (s.fridge_diff_mean, s.fridge_diff_sd) == pytest.approx((26.478022, 19.065311), abs=1e-6)
    assert s.sample_date_diff_mean == s.fridge_diff_mean
    assert (s.catch_time_diff_mean, s.catch_time_diff_sd) == pytest.approx((230.386447, 170.808538), abs=1e-6)
    assert pairs.where("sex_diff = '0'").count() == 813


def test_annotation(machine, curator):
    assert (machine.count(), curator.count()) == (766, 172)
    inner = merge_tables(machine.select("genus", "label1"), curator.select("genus", "expert"), ["genus"])
    assert inner.count() == 135
    full = merge_tables(machine.select("genus", "label1"), curator.select("genus", "expert"), ["genus"], "full")
    assert full.count() == 825
    scored = annotate.compare_sources(
        machine, curator, "genus", "label1", "expert", annotate.AGREE_MACHINE1_CURATOR, "full", ["label1", "expert"])
    assert {r.conflict: r["count"] for r in scored.groupBy("conflict").count().collect()} == {"0": 47, "1": 17}
    labels = machine.groupBy(annotate.harmonise("label1", "machine1").alias("l")).count().collect()
    assert {r.l: r["count"] for r in labels} == {"Anaerobic": 329, "Aerotolerant": 288, "Unknown": 126, "Unassigned": 23}


def test_rescaled_columns_follow_given_parameters(samples):
    from dyadspark.operators.relational import standardise

    given = {"time_in_fridge": (45.49184782608695, 47.90330118497898), "catch_time": (368.2744565217391, 348.94607937579997)}
    out = standardise(samples, list(given), "_again", given)
    for c in given:
        assert out.where(F.abs(F.col(f"{c}_again") - F.col(f"{c}_scaled")) > 1e-6).count() == 0
