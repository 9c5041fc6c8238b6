"""Long to wide, wide to long, and column selection by rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def columns_starting(df: DataFrame, *prefixes: str) -> list[str]:
    """Columns whose name starts with one of the prefixes, in table order."""
    return [c for c in df.columns if c.startswith(tuple(prefixes))]


def interleave(ids: Sequence[str], parts: Sequence[str], levels: Sequence[str]) -> list[str]:
    """Names ordered by level, then part: ``id, a_l1, b_l1, a_l2, b_l2, ...``"""
    return list(ids) + [f"{level}_{part}" for level in levels for part in parts]


def melt(
    df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str, drop_null: bool = False
) -> DataFrame:
    long = df.unpivot(list(ids), list(values), name, value)
    return long.where(F.col(value).isNotNull()) if drop_null else long


def counts_from_wide(df: DataFrame, taxon: str, samples: Sequence[str] | None = None) -> DataFrame:
    """A wide count file (one column per sample) as long non-zero counts."""
    samples = [c for c in df.columns if c != taxon] if samples is None else list(samples)
    long = df.unpivot([taxon], samples, "sample_id", "n")
    return long.where(F.col("n") > 0).select("sample_id", F.col(taxon).alias("taxon_id"), "n")


def aligned_arrays(df: DataFrame, key: str, item: str, value: Column, filler: Column) -> DataFrame:
    """One row per key with ``values``, where position i always means the same item.

    Missing items hold ``filler`` up to the key's ``last`` position. Items are
    numbered over the whole table, so their number must be bounded (core taxa,
    the loci of a panel); arrays are as long as that at most.
    """
    numbered = df.select(item).distinct().withColumn(
        "__p", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(item))
    )
    cell = F.struct(F.col("__p").alias("p"), value.alias("v"))
    entries = df.join(numbered, item).groupBy(key).agg(F.sort_array(F.collect_list(cell)).alias("e"))

    def padded(entry, i):
        before = F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("e"), i - 1).getField("p"))
        return F.concat(F.array_repeat(filler, entry.getField("p") - before - 1), F.array(entry.getField("v")))

    return entries.select(
        key, F.flatten(F.transform("e", padded)).alias("values"), F.element_at("e", -1).getField("p").alias("last")
    )


def pivot_lists(
    df: DataFrame,
    keys: Sequence[str],
    names_from: str,
    values_from: str,
    names: Sequence[str],
    largest: int | None = None,
) -> DataFrame:
    """One row per key with one sorted array per listed name (empty where absent).

    A list cell is one value, so it has to fit in a row; groups without such a bound are kept in long form
    (``roster.group_slots``). With ``largest`` cells are counted first and the job stops if one is longer.
    """
    keys = list(keys)
    rows = df.select(*keys, names_from, values_from)
    lists = F.sort_array(F.collect_list(values_from))
    if largest is None:
        return rows.groupBy(*keys).pivot(names_from, list(names)).agg(lists)
    cells = rows.groupBy(*keys, names_from).agg(F.count(values_from).alias("__n"))
    ok = F.when(F.col("__n") <= largest, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"a list cell holds more than {largest} values")).cast("boolean")
    )
    checked = rows.join(cells.where(ok).drop("__n"), [*keys, names_from])
    return checked.groupBy(*keys).pivot(names_from, list(names)).agg(lists)


def list_widths(df: DataFrame, names: Sequence[str]) -> dict[str, int]:
    """Length of the longest list of each column, at least 1: one row of counts."""
    longest = df.agg(*[F.max(F.size(n)).alias(n) for n in names]).first()
    return {n: max(1, longest[n] or 0) for n in names}


def spread_lists(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Array columns as numbered columns ``<name>_1 ..``, as many as the longest list has."""
    widths = list_widths(df, names)
    kept = [c for c in df.columns if c not in widths]
    cells = [
        F.get(F.col(name), F.lit(i)).alias(f"{name}_{i + 1}") for name, width in widths.items() for i in range(width)
    ]
    return df.select(*kept, *cells)


def spread_slots(
    numbered: DataFrame, keys: Sequence[str], name: str, value: str, widths: dict[str, int], slot: str = "slot"
) -> DataFrame:
    """Long numbered values as columns ``<name>_<slot>``: one partial aggregation, no arrays."""
    cells = [
        F.max(F.when((F.col(name) == n) & (F.col(slot) == i), F.col(value))).alias(f"{n}_{i}")
        for n, width in widths.items()
        for i in range(1, width + 1)
    ]
    return numbered.groupBy(*keys).agg(*cells)


def pivot_values(
    df: DataFrame, keys: Sequence[str], names_from: str, names: Sequence, values: dict[str, str]
) -> DataFrame:
    """Several value columns spread over the listed names: ``<name>_<alias>``."""
    aggs: list[Column] = [F.min(c).alias(alias) for alias, c in values.items()]
    return df.groupBy(*keys).pivot(names_from, list(names)).agg(*aggs)
