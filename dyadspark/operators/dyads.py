"""Classifying and annotating pairs.

Pairs carry the columns of both samples as ``<col>_x`` (earlier sample) and
``<col>_y``. Everything up to the relatedness lookup is computed row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from dyadspark.functions import days_apart, either_order, in_set, not_in_set, strict_greatest, strict_least
from dyadspark.functions.aggregates import summarise_columns
from dyadspark.operators.relational import count_by, distinct_at_ends, distinct_over, first_by, lookup
from dyadspark.session import materialise

# Role sets and class labels.
DOMINANT = ["BrM", "BrF"]
HELPER = ["H"]
SUBORDINATE = ["AB", "ABX"]
PAIRABLE_ROLES = ["BrM", "BrF", "H", "AB", "ABX", "OFL", "FL"]
RELATIONS = ["diffGroup", "sameGroup", "sameBird"]
PAIR_TYPES = [
    "diffGroup", "Dominantpair", "DomHelp", "DomSub", "HelpSub", "SubSub", "sameTerrothers", "sameBird",
]
INTERACTING = ["Dominantpair", "DomHelp"]
SAME_SEASON = "sameyearsameseason"


def _same(name: str) -> Column:
    return F.col(f"{name}_x") == F.col(f"{name}_y")


def relation() -> Column:
    """How two samples are related; the first rule that holds wins."""
    return (
        F.when(_same("sample_id"), "samesample")
        .when(_same("bird_id"), "sameBird")
        .when(_same("group_id"), "sameGroup")
        .when(F.col("group_id_x") != F.col("group_id_y"), "diffGroup")
    )


def season_relation() -> Column:
    return (
        F.when(_same("season") & _same("year"), SAME_SEASON)
        .when(_same("season"), "sameseasondiffyear")
        .when(_same("year"), "sameyeardiffseason")
        .otherwise("diffyeardiffseason")
    )


def with_relations(pairs: DataFrame) -> DataFrame:
    pairs = pairs.withColumn("relation", relation())
    return pairs.where(not_in_set("relation", ["samesample"]))


def both_roles(roles=PAIRABLE_ROLES) -> Column:
    return in_set("role_x", roles) & in_set("role_y", roles)


def shared_tenure() -> Column:
    """The tenure both dominants of a group agree on, else NULL."""
    ok = both_roles(DOMINANT) & _same("seasons_together") & in_set("relation", ["sameGroup"])
    return F.when(ok, F.col("seasons_together_x"))


def covariate_differences(pairs: DataFrame, signed_age: bool = False) -> DataFrame:
    def gap(name):
        return F.col(f"{name}_x") - F.col(f"{name}_y")

    return pairs.withColumns(
        {
            "catch_time_diff": F.abs(gap("catch_time")),
            "fridge_diff": F.abs(gap("time_in_fridge")),
            "sample_date_diff": days_apart("sample_date_x", "sample_date_y"),
            "age_diff": gap("sampling_age") if signed_age else F.abs(gap("sampling_age")),
            "sex_diff": F.when(_same("sex"), "0").otherwise("1"),
        }
    )


def pair_type() -> Column:
    """Class of a pair by the two roles, whichever way round; the first rule that holds wins."""
    def within(cond):
        return cond & in_set("relation", ["sameGroup"])

    roles = ("role_x", "role_y")
    low = HELPER + SUBORDINATE
    return (
        F.when(within(either_order(*roles, DOMINANT, DOMINANT)), "Dominantpair")
        .when(within(either_order(*roles, DOMINANT, HELPER)), "DomHelp")
        .when(within(either_order(*roles, DOMINANT, SUBORDINATE)), "DomSub")
        .when(within(either_order(*roles, HELPER, SUBORDINATE)), "HelpSub")
        .when(within(either_order(*roles, low, low)), "SubSub")
        .when(in_set("relation", ["sameGroup"]), "sameTerrothers")
        .otherwise(F.col("relation"))
    )


def with_pair_type(pairs: DataFrame) -> DataFrame:
    """Add the type; pairs of other roles in a group and of one bird with itself are dropped."""
    typed = pairs.withColumn("pair_type", pair_type())
    return typed.where(not_in_set("pair_type", ["sameTerrothers"]) & not_in_set("relation", ["sameBird"]))


def dyad_key(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns(
        {"bird_a": strict_least("bird_id_x", "bird_id_y"), "bird_b": strict_greatest("bird_id_x", "bird_id_y")}
    )


def with_relatedness(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Look the dyad up among edges ``(bird_a, bird_b, relatedness)`` stored smaller id first."""
    return lookup(pairs, edges, [("bird_a", "bird_a"), ("bird_b", "bird_b")], "left", ["relatedness"])


NATAL_COLUMNS = ["BrF_1", "BrM_1", "H_1", "BrF_2", "BrM_2", "H_2", "H_3"]


def shared_natal() -> Column:
    """``same`` if one bird bred or helped in the natal group of the other, by the published rule.

    Only the first breeders of the second bird's natal group are compared with the first bird; the
    other named attendants are compared with the second bird itself.
    """
    hit = F.lit(False)
    for c in NATAL_COLUMNS:
        other = "bird_id_x" if c in NATAL_COLUMNS[:2] else "bird_id_y"
        hit = hit | F.coalesce(F.col("bird_id_y") == F.col(f"{c}_x"), F.lit(False))
        hit = hit | F.coalesce(F.col(other) == F.col(f"{c}_y"), F.lit(False))
    return F.when(hit, "same").otherwise("different")


def with_shared_natal(pairs: DataFrame, natal: DataFrame) -> DataFrame:
    """``same`` if either bird bred or helped in the natal group of the other: all attendants, both directions.

    ``natal`` is the long natal table; one join on the dyad key, whatever the number of attendants.
    """
    known = natal.where(F.col("attendant").isNotNull()).select(
        F.least("bird_id", "attendant").alias("__a"), F.greatest("bird_id", "attendant").alias("__b")).distinct()
    joined = pairs.join(known, (F.col("bird_a") == F.col("__a")) & (F.col("bird_b") == F.col("__b")), "left")
    return joined.withColumn(
        "shared_natal", F.when(F.col("__a").isNotNull(), "same").otherwise("different")).drop("__a", "__b")


def with_parent(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    return lookup(pairs, parents, [("bird_id_x", "off_id")], "left", ["parent", "spouse_id"])


def alpha_similarity(pairs: DataFrame, as_similarity: bool = True) -> DataFrame:
    sign = F.lit(-1 if as_similarity else 1)
    return pairs.withColumns(
        {
            f"{m}_diff": sign * F.abs(F.col(f"{m}_x") - F.col(f"{m}_y"))
            for m in ("observed", "shannon")
        }
    )


def within_group(pairs: DataFrame) -> DataFrame:
    return pairs.where(in_set("relation", ["sameGroup"]))


def helpers_from_elsewhere(pairs: DataFrame) -> DataFrame:
    return within_group(pairs).where(in_set("pair_type", ["DomHelp"]) & in_set("shared_natal", ["different"]))


def interacting() -> Column:
    return F.when(in_set("pair_type", INTERACTING), "interacting").otherwise("not")


def class_sizes(pairs: DataFrame, by: str) -> DataFrame:
    """Samples and birds taking part in the pairs of each class."""
    samples = distinct_at_ends(pairs, ["sample_id_x", "sample_id_y"], [by], "samples")
    birds = distinct_at_ends(pairs, ["bird_id_x", "bird_id_y"], [by], "birds")
    same = samples[by].eqNullSafe(birds[by])
    return samples.join(birds, same).select(samples[by], "samples", "birds")


def sizes_with_total(pairs: DataFrame, by: str, total: str = "all") -> DataFrame:
    """Pairs, samples and birds of each class and of all classes (``total``), pairs made once.

    What is counted twice is one row for each class and sample, so the distinct counts see no quadratic table.
    """
    ends = [F.struct(F.col(f"sample_id_{e}").alias("sample"), F.col(f"bird_id_{e}").alias("bird")) for e in ("x", "y")]
    met = pairs.select(by, F.inline(F.array(*ends))).groupBy(by, "sample", "bird").agg(F.count(F.lit(1)).alias("n"))
    sizes = met.rollup(by).agg(
        F.grouping(by).alias("__all"), F.expr("sum(n) div 2").alias("pairs"),
        F.count_distinct("sample").alias("samples"), F.count_distinct("bird").alias("birds"))
    return sizes.select(F.when(F.col("__all") == 1, total).otherwise(F.col(by)).alias(by), "pairs", "samples", "birds")


def count_pairs(samples: DataFrame, block) -> DataFrame:
    """Pairs per block, relation and type, without making a single pair.

    The type follows from the two roles and the relation, so products of sample
    counts per role give the numbers: all pairs of a block, less those within
    birds, and those within groups. Work is linear in the samples even where
    one block holds a large part of them.
    """
    block = list(block)
    rows = samples.where(in_set("role", PAIRABLE_ROLES)).select(*block, "group_id", "bird_id", "role")

    def within(keys, in_all=0, in_known=0, in_group=0, known_group=False):
        grain = [*block, *keys]
        needed = [*keys, "group_id"] if known_group else keys
        known = rows.dropna(subset=needed) if needed else rows
        counts = count_by(known, *grain, "role")
        other = counts.select(
            *[F.col(c).alias(f"__{c}") for c in grain], F.col("role").alias("role_y"), F.col("n").alias("n_y")
        )
        same = F.col("role") <= F.col("role_y")
        for c in grain:
            same = (F.col(c) == F.col(f"__{c}")) & same
        twice = F.col("n") * (F.col("n") - 1)
        pairs = F.when(F.col("role") == F.col("role_y"), F.shiftright(twice, 1)).otherwise(F.col("n") * F.col("n_y"))
        return counts.join(other, same).select(
            *block, F.col("role").alias("role_x"), "role_y", (pairs * in_all).alias("all"),
            (pairs * in_known).alias("known"), (pairs * in_group).alias("grp")
        )

    signed = (
        within([], in_all=1)
        .unionByName(within(["bird_id"], in_all=-1))
        .unionByName(within([], in_known=1, known_group=True))
        .unionByName(within(["bird_id"], in_known=-1, known_group=True))
        .unionByName(within(["group_id"], in_group=1))
        .unionByName(within(["group_id", "bird_id"], in_group=-1))
    )
    sums = signed.groupBy(*block, "role_x", "role_y").agg(*[F.sum(c).alias(c) for c in ("all", "known", "grp")])
    # a pair of which one group is missing has no relation
    by_relation = sums.select(*block, "role_x", "role_y", F.inline(F.array(
        F.struct(F.lit("sameGroup").alias("relation"), F.col("grp").alias("n")),
        F.struct(F.lit("diffGroup").alias("relation"), (F.col("known") - F.col("grp")).alias("n")),
        F.struct(F.lit(None).cast("string").alias("relation"), (F.col("all") - F.col("known")).alias("n")),
    )))
    typed = with_pair_type(by_relation).where(F.col("n") > 0)
    return typed.groupBy(*block, "relation", "pair_type").agg(F.sum("n").alias("n"))


def unique_dyads(pairs: DataFrame) -> DataFrame:
    """One pair of samples per pair of birds: the earliest."""
    return first_by(pairs, ["bird_a", "bird_b"], ["sample_id_x", "sample_id_y"])


def dyad_summary(pairs: DataFrame, cols, na_policy: str = "propagate") -> DataFrame:
    slim = pairs.select("bird_a", "bird_b", "sample_id_x", "sample_id_y", *cols)
    return summarise_columns(unique_dyads(slim), cols, na_policy=na_policy)


def dyad_summaries(pairs: DataFrame, cols, by: str, total: str = "all", na_policy: str = "propagate") -> DataFrame:
    """Summaries over unique dyads of each class and over all (``total``); pairs are made once.

    The earliest pair of a dyad in each class is found first, of these the earliest of all.
    """
    order = ["sample_id_x", "sample_id_y"]
    slim = pairs.select(by, "bird_a", "bird_b", *order, *cols)
    in_class = materialise(first_by(slim, [by, "bird_a", "bird_b"], order))
    whole = unique_dyads(in_class).withColumn(by, F.lit(total))
    return summarise_columns(in_class.unionByName(whole), cols, [by], na_policy=na_policy)


def seasons_per_dominant_dyad(pairs: DataFrame) -> DataFrame:
    """In how many seasons each dominant pair was sampled together."""
    dominant = pairs.where(in_set("relation", ["sameGroup"]) & in_set("pair_type", ["Dominantpair"]))
    seasons = dominant.select("bird_a", "bird_b", "season", "year").distinct()
    return count_by(seasons, "bird_a", "bird_b")


def roles_per_bird(pairs: DataFrame) -> DataFrame:
    """Roles of the first birds, one row each, with the number of roles of the bird."""
    roles = pairs.select(F.col("bird_id_x").alias("bird_id"), F.col("role_x").alias("role")).distinct()
    return distinct_over(roles, ["bird_id"], "role", "n_roles")


def role_class(role: str) -> Column:
    return (
        F.when(in_set(role, DOMINANT), "Dom").when(in_set(role, SUBORDINATE + HELPER), "Sub").otherwise("Other")
    )


def role_changes(pairs: DataFrame) -> DataFrame:
    """Birds seen in more than one role class within one territory, a row per class."""
    cols = ["bird_id", "role", "territory_id"]
    ends = [pairs.select(*[F.col(f"{c}_{end}").alias(c) for c in cols]) for end in ("x", "y")]
    stacked = ends[0].unionByName(ends[1]).withColumn("role_class", role_class("role"))
    classes = stacked.select("bird_id", "territory_id", "role_class").distinct()
    counted = distinct_over(classes, ["bird_id", "territory_id"], "role_class", "n_classes")
    return counted.where(F.col("n_classes") > 1)


def marginal_counts(pairs: DataFrame, cols) -> DataFrame:
    """Pair counts per value of each column in one pass: ``what, label, n``."""
    entries = [F.struct(F.lit(c).alias("what"), F.col(c).cast("string").alias("label")) for c in cols]
    return count_by(pairs.select(F.inline(F.array(*entries))), "what", "label")
