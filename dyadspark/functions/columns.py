"""Column expressions with the missing-value rules of the data-frame world.

Everything here is a composition of built-in functions, so it stays inside
whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_set(c: Column | str, values: Iterable) -> Column:
    """Membership that is never NULL: a missing value is simply not in the set."""
    return F.coalesce(_col(c).isin(list(values)), F.lit(False))


def not_in_set(c: Column | str, values: Iterable) -> Column:
    return ~in_set(c, values)


def _all_present(cols: Sequence[Column]) -> Column:
    present = cols[0].isNotNull()
    for c in cols[1:]:
        present = present & c.isNotNull()
    return present


def strict_least(*cols: Column | str) -> Column:
    """Row-wise minimum that is NULL as soon as one input is NULL."""
    cs = [_col(c) for c in cols]
    return F.when(_all_present(cs), F.least(*cs))


def strict_greatest(*cols: Column | str) -> Column:
    """Row-wise maximum that is NULL as soon as one input is NULL."""
    cs = [_col(c) for c in cols]
    return F.when(_all_present(cs), F.greatest(*cs))


def level_rank(c: Column | str, levels: Sequence[str], unlisted: int = 999) -> Column:
    """1-based position of a value in an ordered level list; others sort last."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), _col(c))
    return F.coalesce(F.nullif(pos, F.lit(0)), F.lit(unlisted)).cast("int")


def round_half_even(c: Column | str, digits: int = 0) -> Column:
    return F.bround(_col(c), digits)


def to_number(c: Column | str, kind: str = "double") -> Column:
    """Cast that yields NULL for text that is not a number."""
    return _col(c).try_cast(kind)


def parse_day(c: Column | str, fmt: str = "dd/MM/yyyy") -> Column:
    """Date from text; NULL when the text does not parse."""
    return F.to_date(F.try_to_timestamp(_col(c), F.lit(fmt)))


def days_apart(a: Column | str, b: Column | str) -> Column:
    return F.abs(F.datediff(_col(a), _col(b)))


def either_order(a: Column | str, b: Column | str, first: Iterable, second: Iterable) -> Column:
    """One value lies in ``first`` and the other in ``second``, whichever way round."""
    first, second = list(first), list(second)
    return (in_set(a, first) & in_set(b, second)) | (in_set(b, first) & in_set(a, second))


def nonnull_count(*cols: Column | str) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + _col(c).isNotNull().cast("int")
    return total
