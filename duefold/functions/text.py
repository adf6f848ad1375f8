"""Text-coded values: flags, percentages and money."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import or_raise


def is_true(flag: Column, token: str = "t") -> Column:
    """True where the text equals ``token``; false for other text and for null."""
    return F.coalesce(flag == F.lit(token), F.lit(False))


def _to_double(text: Column, lenient: bool) -> Column:
    if lenient:
        number = text.try_cast("double")
    else:
        number = or_raise(text, text.cast("double"), "a number")
    return F.nanvl(number, F.lit(None).cast("double"))


def parse_percentage(text: Column, lenient: bool = False) -> Column:
    """``'95%'`` to 0.95. Bad text raises, or gives null when ``lenient``."""
    return _to_double(F.replace(text, F.lit("%"), F.lit("")), lenient) / F.lit(100.0)


def parse_money(text: Column, lenient: bool = False) -> Column:
    """``'$1,234.50'`` to 1234.5. Bad text raises, or gives null when ``lenient``."""
    plain = F.replace(F.replace(text, F.lit("$"), F.lit("")), F.lit(","), F.lit(""))
    return _to_double(plain, lenient)
