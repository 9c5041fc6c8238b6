"""Joins, first-row selection, counting and identifiers.

No function here asks for a broadcast. Whether a side is small enough is left
to Spark's own size check (``spark.sql.autoBroadcastJoinThreshold``, re-applied
by AQE on the measured size), so nothing breaks when a lookup table grows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from dyadspark.operators.ranking import ranked
from dyadspark.session import materialise


def _row_salt(df: DataFrame, salts: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salts)).cast("int")


def _suffix_clashes(left, right, keys, suffixes):
    clash = [c for c in left.columns if c in set(right.columns) and c not in keys]
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    right = right.withColumnsRenamed({c: c + suffixes[1] for c in clash})
    return left, right


def merge_tables(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    null_safe: bool = True,
    suffixes: tuple[str, str] = ("_x", "_y"),
    null_salts: int = 16,
) -> DataFrame:
    """Equi-join on same-named keys where a missing key matches a missing key.

    ``how`` is ``inner``, ``left`` or ``full``; clashing non-key columns get the
    suffixes. Rows without a key can be a large part of a table and all carry
    the same (null) key, so the left ones are spread over ``null_salts`` buckets
    and the right ones copied to each. Full joins add the unmatched right rows
    to a left join, which lets AQE split skewed keys (it cannot in a full join).
    """
    if how not in ("inner", "left", "full"):
        raise ValueError(f"unsupported join type {how!r}")
    on = list(on)
    left, right = _suffix_clashes(left, right, on, suffixes)
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in on})

    def same(k):
        a, b = F.col(k), F.col(f"__r_{k}")
        return a.eqNullSafe(b) if null_safe else a == b

    def missing(prefix):
        return reduce(lambda p, q: p | q, [F.col(prefix + k).isNull() for k in on])

    cond = reduce(lambda p, q: p & q, [same(k) for k in on])
    a, b = left, renamed
    if null_safe:
        a = a.withColumn("__salt_l", F.when(missing(""), _row_salt(a, null_salts)).otherwise(F.lit(0)))
        every = F.sequence(F.lit(0), F.lit(null_salts - 1))
        b = b.withColumn(
            "__salt_r", F.explode(F.when(missing("__r_"), every).otherwise(F.array(F.lit(0))))
        )
        cond = (F.col("__salt_l") == F.col("__salt_r")) & cond
    joined = a.join(b, cond, "inner" if how == "inner" else "left")
    joined = joined.drop("__salt_l", "__salt_r", *[f"__r_{k}" for k in on])
    if how != "full":
        return joined
    keys = left.select(*on).distinct()
    match = reduce(lambda p, q: p & q, [same(k) for k in on])
    only_right = renamed.join(keys, match, "left_anti").withColumnsRenamed({f"__r_{k}": k for k in on})
    return joined.unionByName(only_right, allowMissingColumns=True)


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[tuple[str, str]],
    how: str = "left",
    cols: Sequence[str] | None = None,
    suffix: str = "",
) -> DataFrame:
    """Join on differently named keys; the right side's key columns are dropped."""
    right_keys = [r for _, r in keys]
    cols = [c for c in right.columns if c not in right_keys] if cols is None else list(cols)
    side = right.select(
        *[F.col(r).alias(f"__k{i}") for i, r in enumerate(right_keys)],
        *[F.col(c).alias(c + suffix) for c in cols],
    )
    cond = reduce(lambda p, q: p & q, [F.col(l) == F.col(f"__k{i}") for i, (l, _) in enumerate(keys)])
    return left.join(side, cond, how).drop(*[f"__k{i}" for i in range(len(keys))])


def attach_both_ends(
    pairs: DataFrame,
    dim: DataFrame,
    dim_key: str,
    ends: tuple[str, str],
    cols: Sequence[str] | None = None,
    how: str = "left",
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Join one dimension to both ends of a pair, adding ``<col>_x`` and ``<col>_y``.

    Before pairing it is cheaper to enrich the single rows (see ``pair_within``);
    this form is for pair tables that already exist.
    """
    for end, suffix in zip(ends, suffixes):
        pairs = lookup(pairs, dim, [(end, dim_key)], how, cols, suffix)
    return pairs


def attach_many(base: DataFrame, key: str, sources: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """Left-join one column of every source on ``key``: ``(table, column, new name)``."""
    for table, column, name in sources:
        base = merge_tables(base, table.select(key, F.col(column).alias(name)), [key], "left")
    return base


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key under ``order`` (ascending, nulls first).

    Ties fall to the remaining columns, so the result does not depend on the
    partitioning. It is a plain minimum: rows are reduced before the shuffle
    and one hot key never ends up whole in a single task.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    ranks = [(F.col(o) if isinstance(o, str) else o).alias(f"__o{i}") for i, o in enumerate(order)]
    best = df.groupBy(*keys).agg(F.min(F.struct(*ranks, *[F.col(c) for c in rest])).alias("__best"))
    picked = {c: (F.col(c) if c in keys else F.col("__best")[c]) for c in df.columns}
    return best.select(*[v.alias(c) for c, v in picked.items()])


def first_k(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    k: int,
    slot: str = "slot",
    salts: int = 16,
) -> DataFrame:
    """The first ``k`` rows of each key with their 1-based position.

    Two steps: every salt bucket of a key keeps its own first ``k``, then these
    few rows are ranked per key. The result is exact for any distribution.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    rest = [F.col(c) for c in df.columns if c not in keys]
    salted = df.withColumn("__salt", _row_salt(df, salts))
    inner = W.partitionBy(*keys, "__salt").orderBy(*order, *rest)
    outer = W.partitionBy(*keys).orderBy(*order, *rest)
    kept = salted.withColumn("__n", F.row_number().over(inner)).where(F.col("__n") <= k)
    ranked = kept.drop("__n", "__salt").withColumn(slot, F.row_number().over(outer))
    return ranked.where(F.col(slot) <= k)


def running_number(
    df: DataFrame, keys: Sequence[str], order: str, name: str, bucket: int = 4096
) -> DataFrame:
    """1-based running number within ``keys`` along a numeric, key-wise unique ``order``.

    A plain ``row_number`` sorts a whole key in one task. Here only slices of
    ``bucket`` order values are sorted; slice counts give each slice its start.
    """
    keys = list(keys)
    sliced = df.withColumn("__slice", F.floor(F.col(order) / bucket))
    starts = sliced.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__in_slice"))
    before = W.partitionBy(*keys).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.select(
        *[F.col(c).alias(f"__k_{c}") for c in keys], F.col("__slice").alias("__s"),
        F.coalesce(F.sum("__in_slice").over(before), F.lit(0)).alias("__start"),
    )
    within = W.partitionBy(*keys, "__slice").orderBy(order)
    cond = (F.col("__slice") == F.col("__s")) & reduce(
        lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in keys]
    )
    numbered = sliced.withColumn("__n", F.row_number().over(within)).join(starts, cond, "left")
    return numbered.withColumn(name, F.col("__start") + F.col("__n")).select(*df.columns, name)


def dense_id(df: DataFrame, keys: tuple[str, str], name: str) -> DataFrame:
    """Dense 1-based id of a pair of keys, in key order. Rows with a missing key get NULL.

    Only the distinct keys are ranked, by an exact range sort, so neither a frequent key nor an outlying one makes a task larger.
    """
    a, b = keys
    distinct = df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull()).distinct()
    ids = ranked(distinct, a, b, rank="__rank").select(a, b, (F.col("__rank") + 1).alias(name))
    return df.join(ids, [a, b], "left").select(*df.columns, name)


def standardise(
    df: DataFrame,
    cols: Sequence[str],
    suffix: str = "_scaled",
    params: dict[str, tuple[float, float]] | None = None,
) -> DataFrame:
    """Centre and divide by two standard deviations over the whole table.

    The statistics are a one-row scalar subquery, not an unpartitioned window.
    ``params`` (column to (mean, two_sd)) applies given values instead.
    """
    if params:
        return df.withColumns(
            {c + suffix: (F.col(c) - F.lit(params[c][0])) / F.lit(params[c][1]) for c in cols}
        )
    fields = [f(c).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("s", F.stddev_samp))]
    stats = df.agg(F.struct(*fields).alias("s")).scalar()
    return df.withColumns(
        {
            c + suffix: F.try_divide(
                F.col(c) - stats.getField(f"m_{c}"), F.lit(2.0) * stats.getField(f"s_{c}")
            )
            for c in cols
        }
    )


def with_group_totals(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Add whole-group aggregates to every row.

    Aggregate-and-join instead of a window: the aggregate is partial before the
    shuffle and AQE can split a skewed key in the join.
    """
    keys = list(keys)
    totals = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()])
    return df.join(totals, keys, "left")


def share_of_group(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    wide = with_group_totals(df, keys, {"__total": F.sum(value)})
    return wide.withColumn(name, F.try_divide(F.col(value), F.col("__total"))).drop("__total")


def centre_on_group(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    wide = with_group_totals(df, keys, {"__mean": F.avg(value)})
    return wide.withColumn(name, F.col(value) - F.col("__mean")).drop("__mean")


def distinct_over(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Number of distinct values of a column per group, on every row of the group."""
    return with_group_totals(df, keys, {name: F.count_distinct(value)})


def count_by(df: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def mean_of_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean and standard error of the group sizes."""
    sizes = count_by(df, *by)
    return sizes.agg(
        F.avg("n").alias("mean"),
        F.try_divide(F.stddev_samp("n"), F.sqrt(F.count(F.lit(1)))).alias("se"),
    )


def stack_ends(pairs: DataFrame, ends: Sequence[str], name: str, keep: Sequence[str] = ()) -> DataFrame:
    """One row per end of each pair: the kept columns and the end's value."""
    return pairs.select(*keep, F.explode(F.array(*[F.col(e) for e in ends])).alias(name))


def distinct_at_ends(
    pairs: DataFrame, ends: Sequence[str], by: Sequence[str] = (), name: str = "n"
) -> DataFrame:
    """Distinct entities over both ends of the pairs, overall or per class."""
    stacked = stack_ends(pairs, ends, "__e", by).distinct()
    return stacked.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def agreement_rate(df: DataFrame, conflict: str = "conflict", name: str = "agreement") -> DataFrame:
    return df.agg(F.avg((F.col(conflict) == "0").cast("double")).alias(name))


def assert_unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows as they are; the job fails if a key occurs twice."""
    counted = with_group_totals(df, keys, {"__n": F.count(F.lit(1))})
    checked = F.when(F.col("__n") == 1, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"key {', '.join(keys)} is not unique")).cast("boolean")
    )
    return counted.where(checked).select(*df.columns)
