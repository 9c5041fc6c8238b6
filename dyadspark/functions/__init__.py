from dyadspark.functions.columns import (  # noqa: F401
    days_apart, either_order, in_set, level_rank, nonnull_count, not_in_set, parse_day,
    round_half_even, strict_greatest, strict_least, to_number,
)
from dyadspark.functions.aggregates import na_aware, summarise_columns  # noqa: F401
