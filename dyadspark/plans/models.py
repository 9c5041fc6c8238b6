"""The study's models of pair similarity, as data, and fitting them.

Each compares a similarity between classes of pairs given the same covariates,
with both birds as members and the year as random intercept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from dyadspark.operators import dyads
from dyadspark.operators.mixed import Model
from dyadspark.operators.mixed_fit import Fit, fit

COVARIATES = ["age_diff", "catch_time_diff", "fridge_diff", "relatedness"]
COMMON_FACTORS = {"sex_diff": ["0", "1"], "season": ["Major", "Minor"], "shared_natal": ["different", "same"]}
CLASSES = {
    "relation": ["diffGroup", "sameGroup"],
    "pair_type": ["Dominantpair", "DomHelp", "DomSub", "HelpSub", "SubSub"],
    "grouping": ["interacting", "not"],
}


@dataclass(frozen=True)
class Comparison:
    """``pairs`` names the pair table: whole, aerobic or anaerobic; ``by`` the compared class."""

    pairs: str
    response: str
    by: str


# The eleven comparisons of the study.
COMPARISONS = {
    "observed_by_relation": Comparison("whole", "observed_diff", "relation"),
    "shannon_by_relation": Comparison("whole", "shannon_diff", "relation"),
    "observed_by_type": Comparison("whole", "observed_diff", "pair_type"),
    "shannon_by_type": Comparison("whole", "shannon_diff", "pair_type"),
    "similarity_by_relation": Comparison("whole", "similarity", "relation"),
    "similarity_by_type": Comparison("whole", "similarity", "pair_type"),
    "aerobic_by_relation": Comparison("aerobic", "similarity", "relation"),
    "aerobic_by_type": Comparison("aerobic", "similarity", "pair_type"),
    "anaerobic_by_relation": Comparison("anaerobic", "similarity", "relation"),
    "anaerobic_by_type": Comparison("anaerobic", "similarity", "pair_type"),
    "anaerobic_by_interaction": Comparison("anaerobic", "similarity", "grouping"),
}


def model_of(comparison: Comparison, factors: dict | None = None) -> Model:
    levels = CLASSES[comparison.by]
    others = COMMON_FACTORS if factors is None else factors
    return Model(
        comparison.response, COVARIATES, {comparison.by: levels, **others}, ["bird_id_x", "bird_id_y"], "year"
    )


def rows_of(pairs: DataFrame, comparison: Comparison) -> DataFrame:
    """Comparisons within groups leave out pairs of different groups."""
    if comparison.by == "relation":
        return pairs
    return dyads.within_group(pairs).withColumn("grouping", dyads.interacting())


def fit_comparison(pairs: DataFrame, name: str, factors: dict | None = None) -> Fit:
    """Fit one of the comparisons to its pair table."""
    comparison = COMPARISONS[name]
    return fit(rows_of(pairs, comparison), model_of(comparison, factors))


def means_by_class(pairs: DataFrame, name: str) -> DataFrame:
    """Unadjusted mean response per class, next to which the model's estimates are read."""
    comparison = COMPARISONS[name]
    rows = rows_of(pairs, comparison).where(F.col(comparison.response).isNotNull())
    return rows.groupBy(comparison.by).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(comparison.response).alias("mean")
    )
