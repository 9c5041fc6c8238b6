"""Exact ranks of a whole table without one task that holds it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from dyadspark.session import materialise

_PLACE_IN_RANGE = (1 << 33) - 1


def ranked(rows: DataFrame, *order: Column | str, rank: str = "rank") -> DataFrame:
    """``rows`` with ``rank`` (long, 0..) added: the place of each row in the given order.

    The rows are sorted by ranges and written once with their places inside their range, since a second run of a range sort
    could cut elsewhere; then each range is set off by the sizes of those before it. A last sort key without many equal
    values keeps the ranges even; rows equal in all keys are in arbitrary order, and rows with equal keys share a range.
    Give only the columns to carry. An empty table gives none. Columns ``_place``, ``_part`` and ``_before`` must be free.
    """
    placed = _in_ranges(rows, order)
    at = F.col("_place").bitwiseAND(F.lit(_PLACE_IN_RANGE))
    before = _before_ranges(placed, F.count(F.lit(1)))
    return placed.join(before, "_part").withColumn(rank, F.col("_before") + at).drop("_part", "_before", "_place")


def running_sum(rows: DataFrame, weight: str, *order: Column | str, name: str = "before") -> DataFrame:
    """``rows`` with the sum of ``weight`` over all rows before each one in the given order; as ``ranked`` otherwise."""
    placed = _in_ranges(rows, order)
    before = _before_ranges(placed, F.sum(weight))
    inside = F.sum(weight).over(Window.partitionBy("_part").orderBy("_place")) - F.col(weight)
    return placed.withColumn("_in", inside).join(before, "_part").withColumn(
        name, F.col("_before") + F.col("_in")).drop("_part", "_before", "_place", "_in")


def _in_ranges(rows: DataFrame, order) -> DataFrame:
    return materialise(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    ).withColumn("_part", F.shiftright("_place", 33))


def _before_ranges(placed: DataFrame, total: Column) -> DataFrame:
    """_part and the total of all ranges before it: one row for each range of the sort."""
    totals = placed.groupBy("_part").agg(total.alias("_n"))
    return totals.select(
        "_part", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part")) - F.col("_n")).alias("_before"))
