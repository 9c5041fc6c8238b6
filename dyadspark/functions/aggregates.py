"""Aggregates with an explicit rule for missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

STATS = ("min", "max", "mean", "sd", "se")


def na_aware(agg: Column, c: Column | str, na_policy: str = "propagate") -> Column:
    """``propagate``: one missing input makes the result NULL. ``skip``: ignore it."""
    if na_policy == "skip":
        return agg
    if na_policy != "propagate":
        raise ValueError(f"na_policy must be 'propagate' or 'skip', not {na_policy!r}")
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.count(c) == F.count(F.lit(1)), agg)


def summarise_columns(
    df: DataFrame,
    cols: Sequence[str],
    by: Sequence[str] = (),
    stats: Sequence[str] = STATS,
    na_policy: str = "propagate",
) -> DataFrame:
    """min, max, mean, sample sd and standard error of each column, named ``<col>_<stat>``."""
    out = []
    for name in cols:
        x = F.col(name)
        n = F.count(x) if na_policy == "skip" else F.count(F.lit(1))
        forms = {
            "min": F.min(x),
            "max": F.max(x),
            "mean": F.avg(x),
            "sd": F.stddev_samp(x),
            "se": F.stddev_samp(x) / F.sqrt(n),
            "n": n,
        }
        for stat in stats:
            value = forms[stat] if stat == "n" else na_aware(forms[stat], x, na_policy)
            out.append(value.alias(f"{name}_{stat}"))
    return df.groupBy(*by).agg(*out)
