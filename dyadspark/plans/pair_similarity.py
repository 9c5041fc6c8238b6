"""From counts, samples and roster to the classified and annotated pair table.

One parameterised plan serves the whole community and its functional subsets.
What is known about a single sample (group, natal group, alpha diversity,
parent, abundance profile) is joined to the sample before pairing. The
quadratic table is then built once, in the blocks that are compared, and meets
one more join only: the relatedness of the two birds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dyadspark.functions import in_set
from dyadspark.operators import dyads
from dyadspark.operators.community import core_taxa, keep_taxa, log_ratio, relative_abundance
from dyadspark.operators.distance import aitchison_pairs, pair_within, similarity
from dyadspark.operators.relational import lookup
from dyadspark.session import materialise

BLOCK = ("year", "season")


def core_log_ratios(
    abundance: DataFrame, detection: float = 1e-4, prevalence: float = 0.05, zero_policy: str = "shift_all"
) -> DataFrame:
    """Log-ratios over the core taxa of a count table, written out since pairing reads them several times.

    Each step needs whole-table facts of the one before, so give it a stored count table.
    """
    core = core_taxa(relative_abundance(abundance), detection, prevalence)
    return materialise(log_ratio(keep_taxa(abundance, core), zero_policy))


def enrich_samples(
    samples: DataFrame,
    group_dim: DataFrame | None = None,
    natal: DataFrame | None = None,
    alpha: DataFrame | None = None,
    parents: DataFrame | None = None,
) -> DataFrame:
    """Samples with what is known about their group, bird and community, written out: pairing reads them thrice."""
    if group_dim is not None:
        samples = lookup(samples, group_dim, [("group_id", "group_id")])
    if natal is not None:
        samples = lookup(samples, natal, [("bird_id", "bird_id")])
    if alpha is not None:
        samples = lookup(samples, alpha.select("sample_id", "observed", "shannon"), [("sample_id", "sample_id")])
    if parents is not None:
        samples = lookup(samples, parents.select("off_id", "parent"), [("bird_id", "off_id")])
    return materialise(samples)


def pairable(samples: DataFrame) -> DataFrame:
    """Role filter on the single samples: never pair what the classes would drop."""
    return samples.where(in_set("role", dyads.PAIRABLE_ROLES))


def classify(pairs: DataFrame, signed_age: bool = False) -> DataFrame:
    """Relation, type, covariate differences and dyad key of paired samples."""
    pairs = dyads.with_relations(pairs)
    pairs = dyads.with_pair_type(pairs)
    pairs = dyads.covariate_differences(pairs, signed_age)
    return dyads.dyad_key(pairs)


def pair_table(
    samples: DataFrame,
    edges: DataFrame | None = None,
    ratios: DataFrame | None = None,
    block=BLOCK,
    signed_age: bool = False,
    natal: DataFrame | None = None,
    drop_zero: bool = True,
    tile_rows: int = 2048,
    alpha_as_similarity: bool = True,
) -> DataFrame:
    """Classified pairs of the same block; with ``ratios`` also distance and similarity.

    Pairs of one bird with itself are ruled out in the join, the role filter
    runs on single samples. Optional sample columns switch on what they allow:
    natal columns the shared-natal class by the published rule, alpha columns the alpha similarity
    (or difference), ``seasons_together`` the shared tenure. The long table ``natal`` gives the shared-natal
    class over all attendants instead.
    """
    rows = pairable(samples)
    distinct_birds = F.coalesce(F.col("bird_id_x") != F.col("bird_id_y"), F.lit(True))
    if ratios is None:
        pairs = pair_within(rows, block, "ord", distinct_birds, tile_rows)
    else:
        pairs = aitchison_pairs(ratios, rows, block, "ord", distinct_birds, tile_rows)
        pairs = similarity(pairs, drop_zero=drop_zero)
    pairs = classify(pairs, signed_age)
    if "seasons_together" in samples.columns:
        pairs = pairs.withColumn("shared_tenure", dyads.shared_tenure())
    if natal is not None:
        pairs = dyads.with_shared_natal(pairs, natal)
    elif "BrF_1" in samples.columns:
        pairs = pairs.withColumn("shared_natal", dyads.shared_natal())
    if "shannon" in samples.columns:
        pairs = dyads.alpha_similarity(pairs, alpha_as_similarity)
    return pairs if edges is None else dyads.with_relatedness(pairs, edges)


def similarity_by_class(pairs: DataFrame, by: str = "pair_type") -> DataFrame:
    return pairs.groupBy(by).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg("similarity").alias("mean_similarity"),
        F.stddev_samp("similarity").alias("sd_similarity"),
    )
