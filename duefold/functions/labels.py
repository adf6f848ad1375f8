"""Credit labels: 1 is paid, 0 is default, null is grey or unknown."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lateness in days up to which a credit counts as paid, and above
# which it counts as default.
PAID_MAX = 30
DEFAULT_MIN = 60


def three_way_label(
    days: Column, paid_max: int = PAID_MAX, default_min: int = DEFAULT_MIN
) -> Column:
    """1 up to ``paid_max`` days, 0 above ``default_min``, null between or when unknown."""
    return F.when(days <= paid_max, F.lit(1)).when(days > default_min, F.lit(0))


def minimum_days(days_to_due: Column, default_min: int = DEFAULT_MIN) -> Column:
    """Days a credit must have been observed before its label can be trusted."""
    return days_to_due + F.lit(default_min)


def is_mature(observed: Column, minimum: Column) -> Column:
    """True once ``observed`` reaches ``minimum``; false, never null, when either is missing."""
    return F.coalesce(observed >= minimum, F.lit(False))


def keep_if_mature(label: Column, mature: Column) -> Column:
    """The label of a mature credit, else null. Paid and default are treated alike."""
    return F.when(mature, label)
