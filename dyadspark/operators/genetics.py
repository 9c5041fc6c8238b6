"""Genotypes, kept long: ``genotypes(ind, locus, a, b)``."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dyadspark.operators.distance import pair_within
from dyadspark.operators.relational import count_by, share_of_group
from dyadspark.operators.reshape import aligned_arrays, interleave, pivot_values

#: Pairs whose replicates one matrix product makes: with 1,000 replicates a matrix has 4 MB.
_PAIRS_AT_ONCE = 512


def loci_per_method(genotypes: DataFrame) -> DataFrame:
    return genotypes.groupBy("method").agg(F.count_distinct("locus").alias("n"))


def genotypes_wide(genotypes: DataFrame, loci: Sequence) -> DataFrame:
    """One row per individual: id, then both alleles of every locus side by side."""
    wide = pivot_values(genotypes, ["ind"], "locus", loci, {"a": "a", "b": "b"})
    return wide.select(*interleave(["ind"], ["a", "b"], [str(l) for l in loci]))


def allele_frequencies(genotypes: DataFrame) -> DataFrame:
    """Frequency of each allele at its locus; missing alleles do not count."""
    alleles = genotypes.select("locus", F.explode(F.array("a", "b")).alias("allele")).where(
        F.col("allele").isNotNull()
    )
    return share_of_group(count_by(alleles, "locus", "allele"), ["locus"], "n", "freq")


def genotype_profiles(genotypes: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """One row per individual: by locus number its alleles, their summed frequency and homozygosity, NULL if untyped."""
    freqs = allele_frequencies(genotypes) if frequencies is None else frequencies
    typed = genotypes.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    for side in ("a", "b"):
        f = freqs.select("locus", F.col("allele").alias(side), F.col("freq").alias(f"p{side}"))
        typed = typed.join(f, ["locus", side])
    locus = F.struct(
        F.col("locus"), F.col("a"), F.col("b"),
        (F.col("pa") + F.col("pb")).alias("p"),
        (F.col("a") == F.col("b")).cast("double").alias("hom"),
    )
    kind = {n: typed.schema[n].dataType.simpleString() for n in ("locus", "a", "b")}
    none = F.lit(None).cast(f"struct<locus:{kind['locus']},a:{kind['a']},b:{kind['b']},p:double,hom:double>")
    return aligned_arrays(typed, "ind", "locus", locus, none).select("ind", F.col("values").alias("loci"))


def _terms(g: Column, h: Column) -> Column:
    """Numerators and denominators of one locus, per direction; NULL unless typed in both."""

    def same(p, q):
        return (g.getField(p) == h.getField(q)).cast("double")

    ident = (same("a", "a") + same("a", "b") + same("b", "a") + same("b", "b")) * 0.5
    terms = F.struct(
        g.getField("locus").alias("locus"),
        (ident - g.getField("p")).alias("nx"),
        (1.0 + g.getField("hom") - g.getField("p")).alias("dx"),
        (ident - h.getField("p")).alias("ny"),
        (1.0 + h.getField("hom") - h.getField("p")).alias("dy"),
    )
    return F.when(g.isNotNull() & h.isNotNull(), terms)


def relatedness_terms(
    genotypes: DataFrame,
    blocks: DataFrame,
    block: Sequence[str],
    frequencies: DataFrame | None = None,
    tile_rows: int = 2048,
) -> DataFrame:
    """Pairs of individuals of a block with their per-locus terms.

    ``blocks(ind, <block>)`` says who is compared with whom. An individual's
    loci are one short array (as long as the typing panel), so pairs are made
    once and loci are matched inside the row rather than by another shuffle.
    """
    profiles = genotype_profiles(genotypes, frequencies).join(blocks, "ind")
    pairs = pair_within(profiles, block, "ind", tile_rows=tile_rows)
    terms = F.filter(F.zip_with("loci_x", "loci_y", _terms), lambda t: t.isNotNull())
    return pairs.select("ind_x", "ind_y", terms.alias("terms"))


def _ratio(terms: Column, pooling: str) -> Column:
    zero = F.lit(0.0)
    start = F.struct(*[zero.alias(n) for n in ("nx", "dx", "ny", "dy")])
    total = F.aggregate(
        terms, start,
        lambda acc, t: F.struct(*[(acc.getField(n) + t.getField(n)).alias(n) for n in ("nx", "dx", "ny", "dy")]),
    )
    nx, dx, ny, dy = (total.getField(n) for n in ("nx", "dx", "ny", "dy"))
    if pooling == "pooled":
        return F.try_divide(nx + ny, dx + dy)
    if pooling == "mean":
        return (F.try_divide(nx, dx) + F.try_divide(ny, dy)) / 2
    raise ValueError(f"pooling must be 'mean' or 'pooled', not {pooling!r}")


def relatedness(terms: DataFrame, pooling: str = "mean") -> DataFrame:
    """Queller-Goodnight relatedness: per-direction ratios of sums over loci, averaged or pooled."""
    return terms.select("ind_x", "ind_y", _ratio(F.col("terms"), pooling).alias("relatedness"))


def bootstrap_weights(genotypes: DataFrame, replicates: int = 1000, seed: int = 1) -> DataFrame:
    """``replicate, locus, weight``: how often each replicate draws a locus when it draws as many as there are, with replacement.

    The drawn number at place i of replicate r is a hash of (seed, r, i), so a draw repeats exactly. A drawn locus counts for all pairs
    alike. The table has at most replicates x loci rows, whatever the number of individuals.
    """
    loci = genotypes.where(F.col("locus").isNotNull()).select("locus").distinct()
    panel = loci.withColumn("number", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("locus")))
    size = loci.agg(F.count(F.lit(1)).alias("n")).scalar()
    ticket = F.md5(F.concat_ws("|", F.lit(str(seed)), "replicate", "i").cast("binary"))
    number = F.conv(F.substring(ticket, 1, 8), 16, 10).cast("bigint") % F.col("size") + 1
    draws = (
        genotypes.sparkSession.range(1, replicates + 1).withColumnRenamed("id", "replicate")
        .withColumn("size", size)
        .select("replicate", "size", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("size"))).alias("i"))
        .groupBy("replicate", number.alias("number")).agg(F.count(F.lit(1)).alias("weight"))
    )
    return draws.join(panel, "number").select("replicate", "locus", "weight")


def relatedness_limits(
    terms: DataFrame, weights: DataFrame | int, level: float = 0.95, pooling: str = "mean"
) -> DataFrame:
    """Point estimate with percentile limits over replicates of the loci; a pair without a common locus gives no row.

    ``weights(replicate, locus, weight)`` is one table for all pairs (``bootstrap_weights``, or any other), as wide as the typing panel,
    so it goes to the tasks whole. There the pairs of a batch are a pair x locus matrix and all their replicates one
    matrix product. A replicate whose denominator is zero for a pair (below 1e-9) is left out for it; the limits are the
    values at the nearest ranks of the others, NULL where there is none. A number for ``weights`` asks for so many replicates of the
    loci that the pairs have in common.
    """
    if pooling not in ("mean", "pooled"):
        raise ValueError(f"pooling must be 'mean' or 'pooled', not {pooling!r}")
    if isinstance(weights, int):
        weights = bootstrap_weights(terms.select(F.explode("terms.locus").alias("locus")), weights)
    table = weights.select("replicate", "locus", "weight").toPandas()
    panel, at_locus = np.unique(table["locus"].to_numpy(), return_inverse=True)
    runs, at_run = np.unique(table["replicate"].to_numpy(), return_inverse=True)
    dense = np.zeros((len(panel), len(runs)))
    np.add.at(dense, (at_locus, at_run), table["weight"].to_numpy(dtype=float))
    shared = terms.sparkSession.sparkContext.broadcast((pa.array(panel), dense))
    tail = (1 - level) / 2

    def ratio(n: np.ndarray, d: np.ndarray) -> np.ndarray:
        return np.divide(n, d, out=np.full(n.shape, np.nan), where=np.abs(d) >= 1e-9)

    def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loci, weight = shared.value
        for whole in batches:
            for first in range(0, whole.num_rows, _PAIRS_AT_ONCE):
                batch = whole.slice(first, _PAIRS_AT_ONCE)
                lists = batch.column("terms")
                flat, pair = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
                locus = pc.index_in(flat.field("locus"), loci)
                known = locus.is_valid().to_numpy(zero_copy_only=False)
                locus = locus.fill_null(0).to_numpy()

                def sums(name: str) -> np.ndarray:
                    cells = np.zeros((batch.num_rows, len(loci)))
                    cells[pair[known], locus[known]] = flat.field(name).to_numpy()[known]
                    return cells @ weight

                nx, dx, ny, dy = (sums(name) for name in ("nx", "dx", "ny", "dy"))
                if pooling == "pooled":
                    drawn = ratio(nx + ny, dx + dy)
                else:
                    drawn = (ratio(nx, dx) + ratio(ny, dy)) / 2
                drawn.sort(axis=1)  # missing values last
                n = (~np.isnan(drawn)).sum(axis=1)
                row = np.arange(batch.num_rows)
                ends = []
                for q in (tail, 1 - tail):
                    rank = np.floor(q * (n - 1) + 0.5).astype(int).clip(0)
                    ends.append(np.where(n > 0, drawn[row, rank], np.nan) if len(runs) else np.full(len(row), np.nan))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("ind_x", "ind_y", "relatedness")),
                     *(pa.array(e, from_pandas=True) for e in ends), pa.array(n.astype(np.int64))],
                    names=["ind_x", "ind_y", "relatedness", "lower", "upper", "n_replicates"])

    kind = terms.schema["ind_x"].dataType.simpleString()
    pairs = terms.where(F.size("terms") > 0).select(
        "ind_x", "ind_y", _ratio(F.col("terms"), pooling).alias("relatedness"), "terms")
    return pairs.mapInArrow(
        limits, f"ind_x {kind}, ind_y {kind}, relatedness double, lower double, upper double, n_replicates long")
