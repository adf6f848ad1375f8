"""The first value of a column in a given order, with missing values passed over."""

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_non_null(value: Column, order: Sequence[Column]) -> Column:
    """Aggregate: the value of the first row, by ``order``, in which it is not null.

    Null order keys come last. Rows that tie on the whole order are decided by the
    smallest value, so the result does not depend on how the rows are partitioned.
    ``min_by`` passes over rows whose ordering is null, which is where the missing
    values go. It combines on the map side, so a hot key shrinks before the shuffle.
    """
    keys = [part for key in order for part in (key.isNull(), key)]
    return F.min_by(value, F.when(value.isNotNull(), F.struct(*keys, value)))
