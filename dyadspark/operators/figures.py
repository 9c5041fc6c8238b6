"""The numbers behind the figures: bins, box statistics, densities, labels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dyadspark.operators.ranking import running_sum
from dyadspark.operators.relational import count_by
from dyadspark.session import materialise


def histogram(df: DataFrame, value: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal bins over the range of a column; empty bins have the count 0.

    The bin numbered i covers [lo + i w, lo + (i + 1) w), the last one also its upper edge.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("v"))
    span = rows.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi")).alias("s")).scalar()
    lo, width = span.getField("lo"), (span.getField("hi") - span.getField("lo")) / bins
    raw = F.floor(F.try_divide(F.col("v") - lo, width))
    number = F.coalesce(F.least(raw, F.lit(bins - 1).cast("bigint")), F.lit(0).cast("bigint"))
    counted = rows.groupBy(*by, number.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # one 0 for every bin of every class, added to the counts
    empty = counted.select(*by).distinct() if by else counted.agg(F.count(F.lit(1)).alias("__n")).where("__n > 0")
    empty = empty.select(
        *by, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint"))).alias("bin")
    ).withColumn("n", F.lit(0))
    filled = counted.unionByName(empty).groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    return filled.withColumns({"lower": lo + F.col("bin") * width, "upper": lo + (F.col("bin") + 1) * width})


def quantiles(df: DataFrame, value: str, by: str, probs: dict[str, float]) -> DataFrame:
    """Exact quantiles per class with linear interpolation, one column per name.

    Equal values are counted first; the distinct values of all classes are sorted by ranges together, and running sums of the counts
    tell which of them hold the wanted ranks. Neither a class with most rows nor an outlying value makes a task larger.
    """
    values = materialise(
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(by).alias("g"), F.col(value).cast("double").alias("v"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    placed = running_sum(values, "c", F.col("g").asc_nulls_first(), "v")
    span = placed.groupBy(F.col("g").alias("rg")).agg(F.sum("c").alias("n"), F.min("before").alias("base"))
    wanted = []
    for name, p in probs.items():
        h = (F.col("n") - 1) * p
        for rank, weight in ((F.floor(h), 1 - (h - F.floor(h))), (F.floor(h) + 1, h - F.floor(h))):
            place = F.col("base") + F.least(rank, F.col("n") - 1)
            wanted.append(F.struct(F.lit(name).alias("name"), place.alias("place"), weight.alias("w")))
    places = span.select("rg", F.inline(F.array(*wanted)))
    hit = (F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("c"))
    found = placed.join(places, F.col("g").eqNullSafe(F.col("rg")) & hit)
    cells = [F.sum(F.when(F.col("name") == n, F.col("v") * F.col("w"))).alias(n) for n in probs]
    return found.groupBy(F.col("g").alias(by)).agg(*cells)


def box_stats(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles (linear interpolation), whiskers to the last point within 1.5 IQR, outlier count.

    Whiskers need the quartiles first and join the few of them back.
    """
    rows = df.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("v"))
    quart = quantiles(df, value, by, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = (F.col("v") >= F.col("q1") - reach) & (F.col("v") <= F.col("q3") + reach)
    side = quart.withColumnRenamed(by, "__by")
    both = rows.join(side, F.col(by).eqNullSafe(F.col("__by")))
    return both.groupBy(by, "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("v"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("v"))).alias("upper_whisker"),
        F.count_if(~inside).alias("outliers"),
    )


def density(
    df: DataFrame, value: str, by: str, points: int = 64, adjust: float = 0.5, bins: int = 512
) -> DataFrame:
    """Gaussian kernel density per class on a grid of ``points`` over the class's range.

    Rows are first counted in ``bins`` bins per class; only bin counts meet the
    grid, so that step does not grow with the data. Bandwidth: Silverman's rule
    0.9 min(sd, IQR / 1.34) n^(-1/5), times ``adjust``; where the IQR is 0 the sd
    stands for the minimum, and where that is 0 too the size of the value, or 1.
    A class of one row has no density: its rows hold NULL.
    """
    rows = df.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("v"))
    spread = rows.groupBy(by).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.stddev_samp("v").alias("sd"), F.count(F.lit(1)).alias("n")
    )
    quart = quantiles(df, value, by, {"q1": 0.25, "q3": 0.75}).withColumnRenamed(by, "__q")
    spread = spread.join(quart, F.col(by).eqNullSafe(F.col("__q"))).drop("__q")
    narrow = F.least("sd", (F.col("q3") - F.col("q1")) / 1.34)
    scale = F.when(narrow > 0, narrow).when(F.col("sd") > 0, F.col("sd")).when(F.col("lo") != 0, F.abs("lo")).otherwise(1.0)
    spread = spread.withColumn(
        "bw", F.when(F.col("n") > 1, F.lit(0.9 * adjust) * scale * F.pow(F.col("n"), F.lit(-0.2)))).drop("q1", "q3", "sd")
    width = (F.col("hi") - F.col("lo")) / bins
    side = spread.withColumnRenamed(by, "__by")
    raw = F.floor(F.try_divide(F.col("v") - F.col("lo"), width))
    number = F.coalesce(F.least(raw, F.lit(bins - 1).cast("bigint")), F.lit(0).cast("bigint"))
    counts = (
        rows.join(side, F.col(by).eqNullSafe(F.col("__by")))
        .groupBy(by, "lo", "hi", "n", "bw", number.alias("bin"))
        .agg(F.count(F.lit(1)).alias("c"))
    )
    centre = F.col("lo") + (F.col("bin") + 0.5) * width
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    grid = counts.select(
        by, "bw", "n", "c", centre.alias("m"), F.col("lo"), step.alias("step"),
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"),
    ).withColumn("at", F.col("lo") + F.col("point") * F.col("step"))
    z = (F.col("at") - F.col("m")) / F.col("bw")
    kernel = F.col("c") * F.exp(z * z * -0.5) / (F.col("n") * F.col("bw") * math.sqrt(2 * math.pi))
    return grid.groupBy(by, "point", "at").agg(F.sum(kernel).alias("density"))


def count_labels(df: DataFrame, by: str) -> DataFrame:
    """Class sizes with the constant height at which a figure writes them."""
    return count_by(df, by, name="count").withColumn("value", F.lit(0))
