"""Comparing annotation sources of the same labels and merging them into one table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dyadspark.functions import in_set, not_in_set
from dyadspark.operators.relational import attach_many, merge_tables

# Per comparison, the label sets that count as agreement
# (left labels, right labels); None on the left side means any label.
AGREE_MACHINE1_CURATOR = [
    (["Aerobic", "Facultative Anaerobic"], ["Aerobic", "facultatively anaerobic", "mixed"]),
    (["Anaerobic"], ["Anaerobe"]),
    (None, ["unknown"]),
]
AGREE_MACHINE1_PUBLISHED = [
    (["Aerobic", "Facultatively anaerobic"], ["aerotolerant"]),
    (["Anaerobic"], ["anaerobic"]),
    (["Unknown"], ["unknown"]),
    (None, ["unknown"]),
]
AGREE_MACHINE2_CURATOR = [
    (["Aerobic", "Facultative Anaerobic"], ["Aerobic", "facultatively anaerobic", "mixed"]),
    (["Anaerobic"], ["Anaerobe"]),
]
AGREE_MACHINE2_PUBLISHED = [
    (["Aerobic", "Facultative Anaerobic"], ["aerotolerant", "mixed"]),
    (["Anaerobic"], ["anaerobic"]),
]
AGREE_CURATOR_PUBLISHED = [
    (["Aerobic", "facultatively anaerobic"], ["aerotolerant"]),
    (["Anaerobe"], ["anaerobic"]),
    (["Unknown"], ["unknown"]),
    (None, ["unknown"]),
]

# Labels of each source that mean anaerobic and aerotolerant.
VOCABULARY = {
    "machine1": {"Anaerobic": ["Anaerobic"], "Aerotolerant": ["Facultatively anaerobic", "Aerobic"]},
    "machine2": {"Anaerobic": ["Anaerobic"], "Aerotolerant": ["Facultative Anaerobic", "Aerobic"]},
    "curator": {"Anaerobic": ["Anaerobe"], "Aerotolerant": ["facultatively anaerobic", "Aerobic", "mixed"]},
    "published": {"Anaerobic": ["anaerobic"], "Aerotolerant": ["aerotolerant", "Aerobic", "mixed"]},
}


def conflict(left: str, right: str, agreeing) -> Column:
    """``"0"`` where the two labels fall in one of the agreeing pairs of sets, else ``"1"``."""
    agree = F.lit(False)
    for left_set, right_set in agreeing:
        one = in_set(right, right_set)
        agree = agree | (one if left_set is None else in_set(left, left_set) & one)
    return F.when(agree, "0").otherwise("1")


def compare_sources(
    a: DataFrame,
    b: DataFrame,
    key: str,
    left: str,
    right: str,
    agreeing,
    how: str = "inner",
    required: Sequence[str] = (),
) -> DataFrame:
    """Merge two sources (missing keys match) and score each row.

    Rows lacking a ``required`` label are left out. If the rows asked for must
    come from both sides anyway, an inner join is used where a full or left one
    was requested: same result, smaller shuffle.
    """
    if how == "full" and set(required) == {left, right}:
        how = "inner"
    elif how == "full" and set(required) == {left}:
        how = "left"
    elif how == "full" and set(required) == {right}:
        a, b, how = b, a, "left"
    joined = merge_tables(a.select(key, *_only(a, left, right)), b.select(key, *_only(b, left, right)), [key], how)
    for c in required:
        joined = joined.where(F.col(c).isNotNull())
    return joined.withColumn("conflict", conflict(left, right, agreeing)).select(key, left, right, "conflict")


def _only(df: DataFrame, *names: str) -> list[str]:
    return [n for n in names if n in df.columns]


def without_unknown(scored: DataFrame, rules: dict[str, Sequence[str]]) -> DataFrame:
    """Drop scored rows whose label is one of the listed ones; missing labels stay."""
    for c, labels in rules.items():
        scored = scored.where(not_in_set(c, labels))
    return scored


def harmonise(c: str, source: str) -> Column:
    """A source's label as Anaerobic, Aerotolerant, Unknown or (missing) Unassigned."""
    out = None
    for common, labels in VOCABULARY[source].items():
        cond = in_set(c, labels)
        out = F.when(cond, common) if out is None else out.when(cond, common)
    return out.when(F.col(c).isNotNull(), "Unknown").otherwise("Unassigned")


def master_table(genera: DataFrame, key: str, sources: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """All sources side by side per label; ``sources`` maps a name to (table, label column)."""
    return attach_many(genera, key, [(table, column, name) for name, (table, column) in sources.items()])


def harmonise_all(master: DataFrame, names: Sequence[str]) -> DataFrame:
    return master.withColumns({n: harmonise(n, n) for n in names})


def verdict(tested: str, truth: str) -> Column:
    """Correct or Wrong where both say anaerobic or aerotolerant, else Not tested."""
    decided = ["Anaerobic", "Aerotolerant"]
    both = in_set(tested, decided) & in_set(truth, decided)
    return (
        F.when(both & (F.col(tested) == F.col(truth)), "Correct").when(both, "Wrong").otherwise("Not tested")
    )
