"""Who lived in which group, in which role, in which period.

``status(group_id, bird_id, role, status_id)`` and
``groups(group_id, period_id, territory_id)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dyadspark.functions import in_set, level_rank
from dyadspark.operators.relational import first_by, merge_tables, running_number
from dyadspark.operators.reshape import pivot_lists, spread_lists, spread_slots

# Role codes in order of priority, and the eight roles a group roster shows.
ROLE_PRIORITY = [
    "BrM", "BrF", "H", "ABX", "AB", "OFL", "FL", "CH", "BrU", "B", "TBRF", "TBRM", "NSA", "SEEN2", "SEEN1",
]
ROSTER_ROLES = ["BrM", "BrF", "H", "CH", "ABX", "AB", "OFL", "FL"]
NATAL_ROLES = ["BrM", "BrF", "H"]
# The attendants the published rule reads.
NAMED_SLOTS = {"BrF": 2, "BrM": 2, "H": 3}


def best_roles(status: DataFrame, groups: DataFrame, roles: Sequence[str] = ROSTER_ROLES) -> DataFrame:
    """One role per bird and period, the highest in priority; then only the listed roles.

    The choice precedes the role filter, so a bird whose best role is not
    listed disappears instead of falling back to a lesser one.
    """
    placed = merge_tables(
        status.select("group_id", "bird_id", "role"), groups, ["group_id"], "inner", null_safe=False
    )
    best = first_by(placed, ["bird_id", "period_id"], [level_rank("role", ROLE_PRIORITY), "group_id"])
    return best.where(in_set("role", roles))


def group_lists(best: DataFrame, roles: Sequence[str] = ROSTER_ROLES) -> DataFrame:
    """One row per group with a sorted array of birds per role."""
    return pivot_lists(best, ["group_id", "period_id", "territory_id"], "role", "bird_id", roles)


def group_wide(lists: DataFrame, roles: Sequence[str] = ROSTER_ROLES) -> DataFrame:
    """The arrays as ``<role>_1 ..`` up to the longest; ``<role>_n`` tells how many there are in all."""
    return spread_lists(lists.withColumns({f"{r}_n": F.size(r) for r in roles}), roles)


def group_slots(best: DataFrame) -> DataFrame:
    """The roster in long form: every bird with its number within group and role, in bird order."""
    return running_number(best, ["group_id", "role"], "bird_id", "slot").select(
        "group_id", "period_id", "territory_id", "role", "slot", "bird_id"
    )


def group_dimension(best: DataFrame, extra_nonnull_cols: int = 0) -> DataFrame:
    """Size, pair tenure and presence flags per group.

    Works on counts and the first male and female of each group: a partial
    aggregation, no list cells. Tenure numbers the records of one breeding
    pair by group id and is 0 where either is missing or is the code 0.
    """
    role, bird = F.col("role"), F.col("bird_id")

    def has(*names):
        return F.when(F.max(in_set(role, names).cast("int")) == 1, "yes").otherwise("no")

    wide = best.groupBy("group_id", "period_id", "territory_id").agg(
        (F.count(bird) + F.lit(extra_nonnull_cols)).alias("n_members"),
        F.min(F.when(role == "BrM", bird)).alias("male"),
        F.min(F.when(role == "BrF", bird)).alias("female"),
        has("H").alias("helper_present"),
        has("FL", "OFL").alias("fledgling_present"),
    )
    unpaired = F.col("male").isNull() | F.col("female").isNull() | (F.col("male") == 0) | (F.col("female") == 0)
    # groups without a pair are not numbered: each is a key of its own, so they do not meet in one
    wide = wide.withColumns({
        "__m": F.when(unpaired, F.col("group_id")).otherwise(F.col("male")),
        "__f": F.when(unpaired, F.lit(-1)).otherwise(F.col("female")),
    })
    numbered = running_number(wide, ["__m", "__f"], "group_id", "seasons_together")
    return numbered.withColumn(
        "seasons_together", F.when(unpaired, F.lit(0).cast("bigint")).otherwise(F.col("seasons_together"))
    ).select(
        "group_id", "n_members", "seasons_together", "helper_present", "fledgling_present", "territory_id"
    )


def first_records(status: DataFrame, groups: DataFrame) -> DataFrame:
    """The record with the lowest status id of each bird, with its group's place: the natal group."""
    first = first_by(status, ["bird_id"], ["status_id"])
    return merge_tables(first, groups, ["group_id"], "inner", null_safe=False)


def natal_attendants(first: DataFrame, status: DataFrame, roles: Sequence[str] = NATAL_ROLES) -> DataFrame:
    """Breeders and helpers of every natal group, all of them, numbered in bird order: group_id, role, slot, bird_id."""
    present = status.where(in_set("role", roles)).select("group_id", "role", "bird_id").distinct()
    rows = present.join(first.select("group_id").distinct(), "group_id", "left_semi")
    return running_number(rows, ["group_id", "role"], "bird_id", "slot").select("group_id", "role", "slot", "bird_id")


def natal_table(status: DataFrame, groups: DataFrame) -> DataFrame:
    """Natal territory and natal breeders and helpers of each bird, a row each; birds without any have one row."""
    first = first_records(status, groups)
    attendants = natal_attendants(first, status).select(
        "group_id", F.col("role").alias("attendant_role"), "slot", F.col("bird_id").alias("attendant"))
    joined = merge_tables(first, attendants, ["group_id"], "left", null_safe=False)
    return joined.select(
        "bird_id", F.col("territory_id").alias("first_territory_id"), "attendant_role", "slot", "attendant")


def natal_slots(natal: DataFrame, widths: dict[str, int] = NAMED_SLOTS) -> DataFrame:
    """One row per bird with the numbered attendants that the published rule names, as ``<role>_<slot>``."""
    return spread_slots(natal, ["bird_id", "first_territory_id"], "attendant_role", "attendant", widths)


def genetic_parents(offspring: DataFrame, min_confidence: float = 80, order: str = "file_row") -> DataFrame:
    """One parent per offspring: confident rows, the first of each, then those naming a parent."""
    confident = offspring.where(F.col("confidence") > min_confidence)
    first = first_by(confident.select(order, "parent", "off_id", "spouse_id"), ["off_id"], [order])
    return first.where(F.col("parent").isNotNull()).select("parent", "off_id", "spouse_id")
