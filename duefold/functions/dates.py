"""Date arithmetic on zone-less timestamps.

Everything stays on ``TIMESTAMP_NTZ`` and ``DATE``, so the session time zone and its
daylight-saving jumps cannot move a date.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import or_raise


def parse_timestamp(text: Column, pattern: str | None = None) -> Column:
    """Text to a zone-less timestamp; bad text raises. Without a pattern: ISO 8601."""
    if pattern is None:
        return or_raise(text, text.cast("timestamp_ntz"), "a timestamp")
    return or_raise(text, F.to_timestamp_ntz(text, F.lit(pattern)), "a timestamp")


def day_of_month(moment: Column) -> Column:
    return F.dayofmonth(moment)


def month_start(moment: Column) -> Column:
    """The first day of the month, as a date."""
    return F.trunc(moment.cast("date"), "MM")


def month_gap(later: Column, earlier: Column) -> Column:
    """Whole calendar months between two month buckets (31 January to 1 February is 1)."""

    def ordinal(moment: Column) -> Column:
        return F.year(moment) * 12 + F.month(moment)

    return ordinal(later) - ordinal(earlier)


def elapsed_days(later: Column, earlier: Column) -> Column:
    """Whole days from ``earlier`` to ``later``, rounded down: minus six hours is -1."""
    gap = later.cast("timestamp_ntz") - earlier.cast("timestamp_ntz")
    toward_zero = F.extract(F.lit("DAY"), gap)
    overshoot = F.make_dt_interval(toward_zero) > gap
    return toward_zero - overshoot.cast("int")
