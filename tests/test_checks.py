"""Registered queries against their SQL on the smallest data.

A spread of them here; ``DYADSPARK_ALL_CHECKS=1`` runs all (as ``check_oracle.py`` does).
"""

import os

import pytest

from __spark_entry__ import FLAGSHIP, entry, oracle_sql, queries
from check_oracle import compare, connect

SOME = [
    "a1_csv_scan", "b9_row_key", "c5_compound", "d3_full_merge", "d8_unordered_pairs", "e2_first_per_key", "f3_describe",
    "k4_log_ratio", "k5_rarefy", "k7_aitchison_blocked", "k9_agglomerate", "n4_machine2_vs_curator", "n9_verdict",
    "p2_spread_lists", "r6_group_dimension", "r9_natal_table", "w2_running_number", "w4_dense_id", "y7_pair_type",
    "y10_shared_natal", "y21_role_changes", "g4_relatedness", "l10_least_squares", "v2_box_stats", FLAGSHIP,
]
NAMES = list(oracle_sql()) if os.environ.get("DYADSPARK_ALL_CHECKS") else SOME


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_what_its_sql_gives(spark, folder, con, name):
    assert compare(queries()[name](spark, folder), con.sql(oracle_sql()[name])) == ""


def test_entry_and_registration(spark):
    assert entry(spark).columns == ["pair_type", "pairs", "mean_similarity", "sd_similarity"]
    assert set(oracle_sql()) <= set(queries()) and len(queries()) > 150
