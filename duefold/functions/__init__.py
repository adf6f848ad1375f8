"""Column expressions: every function takes and returns a ``Column``."""

from .dates import day_of_month, elapsed_days, month_gap, month_start, parse_timestamp
from .first import first_non_null
from .labels import is_mature, keep_if_mature, minimum_days, three_way_label
from .names import named, or_raise, quoted
from .numbers import absolute_error, is_missing, percentage, round_half_even, squared_error
from .text import is_true, parse_money, parse_percentage

__all__ = [
    "absolute_error",
    "day_of_month",
    "elapsed_days",
    "first_non_null",
    "is_mature",
    "is_missing",
    "is_true",
    "keep_if_mature",
    "minimum_days",
    "month_gap",
    "month_start",
    "named",
    "or_raise",
    "parse_money",
    "parse_percentage",
    "parse_timestamp",
    "percentage",
    "quoted",
    "round_half_even",
    "squared_error",
    "three_way_label",
]
