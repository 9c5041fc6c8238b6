"""Sample-by-taxon count tables, kept long: ``abundance(sample_id, taxon_id, n)``.

Absent taxa have no row. Operators that must account for zeros (prevalence,
log-ratios) do so with counts per sample, so the full sample x taxon grid is
never built.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dyadspark.functions import in_set, round_half_even
from dyadspark.operators import draws
from dyadspark.operators.relational import lookup, share_of_group
from dyadspark.session import fan_out


class Community(NamedTuple):
    abundance: DataFrame
    taxonomy: DataFrame
    samples: DataFrame


def assemble(abundance: DataFrame, taxonomy: DataFrame, samples: DataFrame) -> Community:
    """Keep only the samples and taxa known to all three tables."""
    kept = abundance.join(samples.select("sample_id"), "sample_id", "left_semi").join(
        taxonomy.select("taxon_id"), "taxon_id", "left_semi"
    )
    return Community(
        kept.select("sample_id", "taxon_id", "n"),
        taxonomy.join(kept.select("taxon_id").distinct(), "taxon_id", "left_semi"),
        samples.join(kept.select("sample_id").distinct(), "sample_id", "left_semi"),
    )


def filter_samples(abundance: DataFrame, samples: DataFrame, predicate) -> tuple[DataFrame, DataFrame]:
    """Filter the sample table and drop the counts of the samples that went."""
    kept = samples.where(predicate)
    return abundance.join(kept.select("sample_id"), "sample_id", "left_semi"), kept


def keep_taxa(abundance: DataFrame, taxa: DataFrame) -> DataFrame:
    return abundance.join(taxa.select("taxon_id"), "taxon_id", "left_semi")


def melt_community(community: Community) -> DataFrame:
    """One long table: counts with taxonomy and sample columns."""
    return community.abundance.join(community.taxonomy, "taxon_id").join(community.samples, "sample_id")


def relative_abundance(abundance: DataFrame) -> DataFrame:
    return share_of_group(abundance, ["sample_id"], "n", "share")


def _scalar(df: DataFrame, agg):
    return df.agg(agg.alias("v")).scalar()


def core_taxa(
    shares: DataFrame, detection: float = 1e-4, prevalence: float = 0.05, samples: DataFrame | None = None
) -> DataFrame:
    """Taxa whose share exceeds ``detection`` in more than ``prevalence`` of all samples.

    All samples count, also those lacking the taxon. With at most 1/detection
    taxa above detection per sample, at most 1/(detection * prevalence) taxa
    can qualify, however large the input.
    """
    everyone = shares.select("sample_id").distinct() if samples is None else samples
    n = _scalar(everyone, F.count(F.lit(1)))
    return (
        shares.groupBy("taxon_id")
        .agg(F.count_if(F.col("share") > detection).alias("__hits"))
        .where(F.col("__hits") / n > prevalence)
        .select("taxon_id")
    )


def log_ratio(abundance: DataFrame, zero_policy: str = "shift_all") -> DataFrame:
    """Centred log-ratio per sample over all taxa of the table, zeros included.

    Rows: the present taxa with ``clr``; every absent taxon of the sample has
    the value ``clr_absent`` carried on the same rows, and ``lift = clr -
    clr_absent`` is zero for it. The pseudocount is half the smallest positive
    share: added to every share (``shift_all``) or only standing in for zeros
    (``replace_zero``).
    """
    if zero_policy not in ("shift_all", "replace_zero"):
        raise ValueError(f"unknown zero_policy {zero_policy!r}")
    shares = relative_abundance(abundance.where(F.col("n") > 0))
    facts = _scalar(
        shares, F.struct((F.min("share") / 2).alias("half"), F.count_distinct("taxon_id").alias("taxa"))
    )
    half, n_taxa = facts.getField("half"), facts.getField("taxa")
    present = F.col("share") + half if zero_policy == "shift_all" else F.col("share")
    logs = shares.withColumns({"__log": F.ln(present), "__absent": F.ln(half)})
    means = logs.groupBy("sample_id").agg(
        F.sum("__log").alias("__sum"), F.count(F.lit(1)).alias("__k"), F.min("__absent").alias("__a")
    ).select(
        "sample_id",
        ((F.col("__sum") + (n_taxa - F.col("__k")) * F.col("__a")) / n_taxa).alias("__mean"),
    )
    return logs.join(means, "sample_id").select(
        "sample_id",
        "taxon_id",
        (F.col("__log") - F.col("__mean")).alias("clr"),
        (F.col("__absent") - F.col("__mean")).alias("clr_absent"),
        (F.col("__log") - F.col("__absent")).alias("lift"),
    )


#: Reads of one row that stay together, and reads of a sample that are drawn from in one task.
_RUN, _TASK = 1 << 14, 1 << 18


def rarefy(abundance: DataFrame, depth: int = 8000, seed: int = 88) -> DataFrame:
    """Draw ``depth`` reads per sample without replacement; shallower samples go.

    Every read gets the hash of (seed, sample, taxon, number) as its ticket and
    each sample keeps its ``depth`` smallest, so the draw repeats exactly and
    does not depend on partitioning. Counts are dealt by sample and tickets exist inside a task only, a block of reads at a time
    (``draws``). A sample of more than ``_TASK`` reads is dealt to many tasks in runs of reads; these hand on the reads
    below a bound that little more than ``depth`` of them pass, and the draw is made from those.
    Where reads are too many to list at all, ``rarefy_deep`` divides counts instead.
    """
    spark = abundance.sparkSession
    parts = fan_out(spark)
    key_type, taxon_type = (abundance.schema[c].dataType.simpleString() for c in ("sample_id", "taxon_id"))
    shape = f"sample_id {key_type}, taxon_id {taxon_type}, n bigint"
    counts = abundance.select("sample_id", "taxon_id", F.col("n").cast("bigint").alias("n")).dropna(subset=["sample_id", "n"])
    totals = counts.groupBy("sample_id").agg(F.sum("n").alias("total")).where(F.col("total") >= depth)
    prefix = F.concat_ws("|", F.lit(str(seed)), F.col("sample_id").cast("string"), F.col("taxon_id").cast("string"), F.lit(""))

    def arrow(text: str) -> pa.Schema:
        return to_arrow_schema(T.StructType.fromDDL(text))

    huge = totals.agg(F.max("total")).first()[0]
    huge = totals.where(F.col("total") > _TASK) if huge is not None and huge > _TASK else None
    whole = counts if huge is None else counts.join(huge, "sample_id", "left_anti")
    dealt = whole.repartition(parts, "sample_id").sortWithinPartitions("sample_id")
    drawn = dealt.select("sample_id", "taxon_id", prefix.alias("prefix"), F.lit(1).cast("bigint").alias("first"), F.col("n").alias("last"))
    drawn = drawn.mapInArrow(draws.draw(depth, arrow(shape)), shape)
    if huge is not None:
        run = F.col("run")
        runs = counts.where(F.col("n") > 0).join(huge, "sample_id").withColumn(
            "run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / _RUN))))
        runs = runs.repartition(parts, "sample_id", "taxon_id", "run").select(
            "sample_id", "taxon_id", "total", prefix.alias("prefix"), (run * _RUN + 1).alias("first"),
            F.least("n", (run + 1) * _RUN).alias("last"))
        few = f"sample_id {key_type}, taxon_id {taxon_type}, high bigint, low bigint"
        found = runs.mapInArrow(draws.candidates(depth, arrow(few)), few)
        found = found.repartition(parts, "sample_id").sortWithinPartitions("sample_id")
        drawn = drawn.unionByName(found.mapInArrow(draws.draw_candidates(depth, arrow(shape)), shape))
    return drawn


def _seed_of(seed: int, *labels) -> np.random.Generator:
    import zlib

    return np.random.default_rng([seed, zlib.crc32("|".join(map(str, labels)).encode())])


def rarefy_deep(abundance: DataFrame, depth: int = 8000, seed: int = 88, bucket_taxa: int = 4096) -> DataFrame:
    """Rarefaction for counts too large to list read by read.

    A sample's taxa are cut into buckets of about ``bucket_taxa``. The reads to
    draw are first divided among the buckets by one multivariate hypergeometric
    draw, then within each bucket by another, which together is the same
    distribution. A task sees one bucket of one sample.
    """
    counts = abundance.where(F.col("n") > 0)
    totals = counts.groupBy("sample_id").agg(
        F.sum("n").alias("__t"), F.ceil(F.count(F.lit(1)) / bucket_taxa).alias("__buckets")
    ).where(F.col("__t") >= depth)
    bucket = F.pmod(F.xxhash64("taxon_id"), F.col("__buckets")).cast("int")
    counts = counts.join(totals, "sample_id").withColumn("bucket", bucket)
    per_bucket = counts.groupBy("sample_id", "bucket").agg(F.sum("n").alias("total"))
    key_type = abundance.schema["sample_id"].dataType.simpleString()
    taxon_type = abundance.schema["taxon_id"].dataType.simpleString()

    def divide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        rng = _seed_of(seed, pdf["sample_id"].iloc[0])
        drawn = rng.multivariate_hypergeometric(pdf["total"].to_numpy("int64"), depth, method="marginals")
        return pdf.assign(quota=drawn)[["sample_id", "bucket", "quota"]]

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("taxon_id")
        rng = _seed_of(seed, pdf["sample_id"].iloc[0], pdf["bucket"].iloc[0])
        quota = int(pdf["quota"].iloc[0])
        drawn = rng.multivariate_hypergeometric(pdf["n"].to_numpy("int64"), quota, method="marginals")
        out = pdf.assign(n=drawn)[["sample_id", "taxon_id", "n"]]
        return out[out["n"] > 0]

    quotas = per_bucket.groupBy("sample_id").applyInPandas(
        divide, f"sample_id {key_type}, bucket int, quota bigint"
    )
    return (
        counts.select("sample_id", "taxon_id", "n", "bucket").join(quotas, ["sample_id", "bucket"])
        .groupBy("sample_id", "bucket")
        .applyInPandas(draw, f"sample_id {key_type}, taxon_id {taxon_type}, n bigint")
    )


def alpha_diversity(abundance: DataFrame) -> DataFrame:
    """Observed taxa, Shannon entropy (natural log) and bias-corrected Chao1 per sample.

    Shannon needs the sample total; as sum(n ln n) and sum(n) it is one pass
    and one aggregation: H = ln N - sum(n ln n) / N.
    """
    counts = abundance.select("sample_id", round_half_even(F.col("n").cast("double")).alias("n"))
    n = F.col("n")
    one, two = F.count_if(n == 1), F.count_if(n == 2)
    observed = F.count_if(n > 0)
    total = F.sum(n)
    return counts.groupBy("sample_id").agg(
        observed.alias("observed"),
        F.when(total > 0, F.ln(total) - F.sum(F.when(n > 0, n * F.ln(n))) / total).alias("shannon"),
        (observed + one * (one - 1) / (2 * (two + 1))).alias("chao1"),
    )


def alpha_with_metadata(abundance: DataFrame, samples: DataFrame, missing_catch_time: int = 43292) -> DataFrame:
    """Alpha diversity joined to the sample table, with the stand-in for a missing catch time."""
    filled = samples.withColumn("catch_time", F.coalesce("catch_time", F.lit(missing_catch_time)))
    return filled.join(alpha_diversity(abundance), "sample_id")


def agglomerate(
    abundance: DataFrame, taxonomy: DataFrame, ranks: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """Sum counts over taxa with the same labels down to the last of ``ranks``.

    Taxa without a label at that rank are dropped. Each group is represented by
    its most abundant taxon (smallest id among equals). Returns counts and the
    taxonomy of the representatives.
    """
    labelled = taxonomy.where(F.col(ranks[-1]).isNotNull()).select("taxon_id", *ranks)
    sizes = abundance.groupBy("taxon_id").agg(F.sum("n").alias("total"))
    weighed = labelled.join(sizes, "taxon_id")
    groups = weighed.groupBy(*ranks).agg(F.min(F.struct(-F.col("total"), F.col("taxon_id"))).alias("top"))
    groups = groups.select(*ranks, F.col("top.taxon_id").alias("representative"))
    same = [labelled[r].eqNullSafe(groups[r]) for r in ranks]
    mapping = labelled.join(groups, same).select(labelled["taxon_id"], groups["representative"])
    merged = (
        abundance.join(mapping, "taxon_id")
        .groupBy("sample_id", "representative")
        .agg(F.sum("n").alias("n"))
        .withColumnRenamed("representative", "taxon_id")
    )
    return merged, groups.withColumnRenamed("representative", "taxon_id")


def functional_subset(
    abundance: DataFrame,
    taxonomy: DataFrame,
    annotation: DataFrame,
    classes: Sequence[str],
    ranks: Sequence[str],
    members: str = "representative",
    label: str = "class",
) -> DataFrame:
    """Counts of the taxa whose group carries one of the annotation classes.

    ``representative`` keeps one taxon per group, ``all`` every taxon of it.
    """
    genus = ranks[-1]
    wanted = annotation.where(in_set(label, classes)).select(genus).distinct()
    if members == "representative":
        _, groups = agglomerate(abundance, taxonomy, ranks)
        ids = groups.join(wanted, genus, "left_semi").select("taxon_id")
    elif members == "all":
        ids = taxonomy.join(wanted, genus, "left_semi").select("taxon_id")
    else:
        raise ValueError(f"members must be 'representative' or 'all', not {members!r}")
    return keep_taxa(abundance, ids)


#: Classes of an annotation that go together in a block.
_CLASSES = 1024


def functional_profile(
    abundance: DataFrame,
    taxonomy: DataFrame,
    annotation: DataFrame,
    ranks: Sequence[str],
    label: str = "class",
) -> DataFrame:
    """Sum of group log-ratios per sample and annotation class.

    Absent groups add their (common) value too, as a count times that value.
    A class none of whose groups occurs in a sample still gets its row.
    """
    counts, groups = agglomerate(abundance, taxonomy, ranks)
    genus = ranks[-1]
    classes = lookup(groups.select("taxon_id", genus), annotation, [(genus, genus)], "left", [label])
    ratios = log_ratio(counts)
    base = ratios.groupBy("sample_id").agg(F.min("clr_absent").alias("absent"))
    sizes = classes.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    # every sample meets every class: by blocks of about _CLASSES classes, so that no row or task holds a long vocabulary
    n_blocks = sizes.agg(F.ceil(F.count(F.lit(1)) / _CLASSES).alias("n")).scalar()
    blocked = sizes.withColumn("block", F.pmod(F.xxhash64(label), n_blocks)).groupBy("block").agg(
        F.collect_list(F.struct(label, "size")).alias("members"))
    lifts = lookup(ratios, classes, [("taxon_id", "taxon_id")], "inner", [label])
    lifts = lifts.groupBy("sample_id", label).agg(F.sum("lift").alias("lift"))
    spread = base.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), n_blocks - 1)))
    grid = spread.join(blocked, "block").select("sample_id", "absent", F.inline("members").alias(label, "size"))
    same = (grid["sample_id"] == lifts["sample_id"]) & grid[label].eqNullSafe(lifts[label])
    return grid.join(lifts, same, "left").select(
        grid["sample_id"],
        grid[label],
        (F.coalesce(lifts["lift"], F.lit(0.0)) + grid["size"] * grid["absent"]).alias("sum_clr"),
    )


def label_catalogue(taxonomy: DataFrame, rank: str) -> DataFrame:
    """Distinct labels at a rank; a missing label is one of them."""
    return taxonomy.select(rank).distinct()


def sample_matrix(abundance: DataFrame, taxa: Sequence[str]) -> DataFrame:
    """Samples as rows, the listed taxa as columns, zeros where absent. An export form only."""
    return abundance.groupBy("sample_id").pivot("taxon_id", list(taxa)).sum("n").fillna(0, list(taxa))
