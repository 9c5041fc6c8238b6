"""Pairing rows and measuring how far apart two samples are."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from dyadspark.operators.reshape import aligned_arrays
from dyadspark.session import fan_out


def pair_within(
    rows: DataFrame,
    block: Sequence[str],
    order: str,
    where: Column | None = None,
    tile_rows: int = 2048,
    partitions: int | None = None,
) -> DataFrame:
    """All unordered pairs of rows of the same block, earlier row first.

    Columns come out as ``<col>_x`` (earlier by ``order``) and ``<col>_y``,
    block columns once. ``where`` is a condition on such columns, checked
    inside the join so that unwanted pairs never leave it.

    A block of n rows yields n(n-1)/2 pairs, so one big block would be one
    endless task. Blocks are cut into hash tiles of about ``tile_rows`` rows
    and every combination of tiles is its own join key: no task pairs more than
    a tile with a tile, and a block that fits one tile is not copied at all.
    Put everything known about a row on it first; the pairs then need no joins.
    """
    if not block:
        one = rows.withColumn("__all", F.lit(0))
        return pair_within(one, ["__all"], order, where, tile_rows, partitions).drop("__all")
    block = list(block)
    spark = rows.sparkSession
    parts = partitions or fan_out(spark)
    sizes = rows.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("__tiles"))
    sized = rows.join(sizes, block)
    tile = F.pmod(F.xxhash64(order), F.col("__tiles"))
    tiled = sized.withColumn("__own", tile).withColumn(
        "__other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__tiles") - 1))
    )
    data = [c for c in rows.columns if c not in block]
    keys = [*block, "__tx", "__ty"]
    x = tiled.select(
        *block, F.col("__own").alias("__tx"), F.col("__other").alias("__ty"),
        *[F.col(c).alias(c + "_x") for c in data],
    ).repartition(parts, *keys)
    y = tiled.select(
        *[F.col(c).alias(f"__y_{c}") for c in block],
        F.col("__other").alias("__y___tx"), F.col("__own").alias("__y___ty"),
        *[F.col(c).alias(c + "_y") for c in data],
    ).repartition(parts, *[f"__y_{c}" for c in keys])
    cond = F.col(order + "_x") < F.col(order + "_y")
    for c in keys:
        cond = (F.col(c) == F.col(f"__y_{c}")) & cond
    if where is not None:
        cond = cond & where
    return x.join(y, cond).drop("__tx", "__ty", *[f"__y_{c}" for c in keys])


def profile_arrays(ratios: DataFrame) -> DataFrame:
    """One row per sample: ``lifts``, its ``lift`` of every taxon by taxon number, and their sum.

    Absent taxa hold 0. The core filter bounds the number of taxa, ``n_taxa``.
    """
    arrays = aligned_arrays(ratios, "sample_id", "taxon_id", F.col("lift"), F.lit(0.0))
    arrays = arrays.withColumn("n_taxa", taxon_count(ratios))
    tail = F.array_repeat(F.lit(0.0), F.col("n_taxa").cast("int") - F.col("last"))
    whole = arrays.select("sample_id", "n_taxa", F.concat("values", tail).alias("lifts"))
    return whole.withColumn("lift_sum", F.aggregate("lifts", F.lit(0.0), lambda acc, v: acc + v))


def array_distance() -> Column:
    """Aitchison distance of a pair from its ``lifts`` arrays, their sums and the number of taxa T.

    With u the difference of the lifts, the squared distance of the centred
    values is sum(u^2) - sum(u)^2 / T; identical profiles give exactly 0.
    """
    squares = F.zip_with("lifts_x", "lifts_y", lambda p, q: (p - q) * (p - q))
    total = F.aggregate(squares, F.lit(0.0), lambda acc, v: acc + v)
    gap = F.col("lift_sum_x") - F.col("lift_sum_y")
    return F.sqrt(F.greatest(total - gap * gap / F.col("n_taxa_x"), F.lit(0.0)))


def taxon_count(ratios: DataFrame) -> Column:
    """Number of taxa as a one-row scalar subquery."""
    return ratios.select("taxon_id").distinct().agg(F.count(F.lit(1)).cast("double").alias("t")).scalar()


def similarity(pairs: DataFrame, distance: str = "distance", drop_zero: bool = True):
    """Similarity is minus the distance; coinciding samples (distance exactly 0) are dropped unless told otherwise."""
    if drop_zero:
        pairs = pairs.where(F.col(distance) > 0)
    return pairs.withColumn("similarity", -F.col(distance))


def distance_long(ratios: DataFrame, pairs: DataFrame) -> DataFrame:
    """Distances of given pairs ``(sample_id_x, sample_id_y)`` by joins on the taxon.

    Only products of taxa present in both samples are joined; norms and sums
    are per-sample aggregates. Suits few pairs over very many taxa.
    """
    n_taxa = taxon_count(ratios)
    stats = ratios.groupBy("sample_id").agg(
        F.sum(F.col("lift") * F.col("lift")).alias("q"), F.sum("lift").alias("s")
    )
    a = ratios.select(F.col("sample_id").alias("sample_id_x"), "taxon_id", F.col("lift").alias("lift_x"))
    b = ratios.select(F.col("sample_id").alias("sample_id_y"), "taxon_id", F.col("lift").alias("lift_y"))
    ids = pairs.select("sample_id_x", "sample_id_y")
    dots = (
        ids.join(a, "sample_id_x")
        .join(b, ["sample_id_y", "taxon_id"])
        .groupBy("sample_id_x", "sample_id_y")
        .agg(F.sum(F.col("lift_x") * F.col("lift_y")).alias("dot"))
    )
    out = pairs.join(dots, ["sample_id_x", "sample_id_y"], "left")
    for end in ("x", "y"):
        side = stats.select(
            F.col("sample_id").alias(f"sample_id_{end}"), F.col("q").alias(f"q_{end}"), F.col("s").alias(f"s_{end}")
        )
        out = out.join(side, f"sample_id_{end}")
    gap = F.col("s_x") - F.col("s_y")
    norm = F.col("q_x") + F.col("q_y")
    squared = norm - 2 * F.coalesce("dot", F.lit(0.0)) - gap * gap / n_taxa
    squared = F.when(squared <= norm * 1e-14, F.lit(0.0)).otherwise(squared)
    return out.withColumn("distance", F.sqrt(squared)).drop("dot", "q_x", "q_y", "s_x", "s_y")


def distance_tiles(
    ratios: DataFrame, samples: DataFrame, block: Sequence[str], order: str = "ord", tile_rows: int = 512
) -> DataFrame:
    """Distances of all pairs of a block, tile against tile by matrix product.

    For many taxa: a task gets two tiles of at most about ``tile_rows`` samples
    each and turns them into one dense product. Spark partitions and shuffles the tiles;
    the result has ids only: ``sample_id_x, sample_id_y, distance``.
    """
    spark = samples.sparkSession
    block = list(block)
    cells = ratios.groupBy("sample_id").agg(
        F.collect_list("taxon_id").alias("taxa"), F.collect_list("lift").alias("lifts")
    )
    sizes = samples.groupBy(*block).agg(F.ceil(F.count(F.lit(1)) / tile_rows).alias("__tiles"))
    rows = (
        samples.select(*block, "sample_id", F.col(order).alias("ord"))
        .join(cells, "sample_id")
        .join(sizes, block)
        .withColumn("__own", F.pmod(F.xxhash64("sample_id"), F.col("__tiles")))
        .withColumn("n_taxa", taxon_count(ratios))
    )
    # unordered tile pairs: the lower number is side a, the higher side b
    a = rows.withColumn("__b", F.explode(F.sequence(F.col("__own"), F.col("__tiles") - 1)))
    b = rows.withColumn("__a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("__own"))))
    keys = [*block, "__a", "__b"]
    parts = fan_out(spark)
    data = ["sample_id", "ord", "taxa", "lifts", "n_taxa"]
    a = a.select(*block, F.col("__own").alias("__a"), "__b", *data).repartition(parts, *keys)
    fresh = [F.col(c).alias(c) for c in [*block, "__a"]]  # the two sides must not share column ids
    b = b.select(*fresh, F.col("__own").alias("__b"), *[F.col(c).alias(c) for c in data]).repartition(parts, *keys)
    id_type = samples.schema["sample_id"].dataType.simpleString()

    def dense(pdf, index):
        out = np.zeros((len(pdf), len(index)))
        for row, (taxa, lifts) in enumerate(zip(pdf["taxa"], pdf["lifts"])):
            out[row, index.get_indexer(taxa)] = lifts
        return out

    def measure(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"sample_id_x": [], "sample_id_y": [], "distance": []})
        if left.empty or right.empty:
            return empty
        index = pd.Index(np.unique(np.concatenate([*left["taxa"], *right["taxa"]])))
        va, vb = dense(left, index), dense(right, index)
        n_taxa = float(left["n_taxa"].iloc[0])
        norm = (va**2).sum(1)[:, None] + (vb**2).sum(1)[None, :]
        gap = va.sum(1)[:, None] - vb.sum(1)[None, :]
        squared = norm - 2.0 * (va @ vb.T) - gap**2 / n_taxa
        squared[squared <= norm * 1e-14] = 0.0
        oa, ob = left["ord"].to_numpy(), right["ord"].to_numpy()
        ia, ib = left["sample_id"].to_numpy(), right["sample_id"].to_numpy()
        one_tile = left["__a"].iloc[0] == left["__b"].iloc[0]
        i, j = np.nonzero(oa[:, None] < ob[None, :] if one_tile else oa[:, None] != ob[None, :])
        first = oa[i] < ob[j]
        return pd.DataFrame(
            {
                "sample_id_x": np.where(first, ia[i], ib[j]),
                "sample_id_y": np.where(first, ib[j], ia[i]),
                "distance": np.sqrt(squared[i, j]),
            }
        )

    return (
        a.groupBy(*keys)
        .cogroup(b.groupBy(*keys))
        .applyInPandas(measure, f"sample_id_x {id_type}, sample_id_y {id_type}, distance double")
    )


def aitchison_pairs(
    ratios: DataFrame, samples: DataFrame, block: Sequence[str], order: str = "ord", where: Column | None = None,
    tile_rows: int = 2048,
) -> DataFrame:
    """Pairs of a block with their distance; sample columns ride along as ``_x`` / ``_y``.

    The distance is put on the row by a generator. As a plain expression a later
    filter on it would be pushed into the join condition and be evaluated for
    every candidate, in interpreted code, and then once more for the output.
    """
    profiles = profile_arrays(ratios)
    rows = samples.join(profiles, "sample_id")
    pairs = pair_within(rows, block, order, where, tile_rows)
    made = [c + end for c in profiles.columns if c != "sample_id" for end in ("_x", "_y")]
    return pairs.select("*", F.explode(F.array(array_distance())).alias("distance")).drop(*made)
