"""Columns by their exact names, and errors that no session setting can silence."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """The name in backticks, so that dots are part of it."""
    return "`" + name.replace("`", "``") + "`"


def named(name: str) -> Column:
    return F.col(quoted(name))


def unused(name: str, columns) -> str:
    """A name like this one that none of the columns has, letter case aside."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def or_raise(text: Column, value: Column, what: str) -> Column:
    """The value parsed from a text; an error if there is a text but no value.

    With ANSI mode off a cast that fails gives null in silence.
    """
    failed = F.raise_error(F.concat(F.lit(f"not {what}: "), text))
    return F.when(text.isNotNull() & value.isNull(), failed).otherwise(value)
