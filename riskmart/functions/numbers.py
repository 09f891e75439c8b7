"""Text to number and safe division, without ANSI errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DECIMAL_TEXT = r"^\s*([+-]?)(\d*)(\.\d*)?\s*$"


def int_or_null(col: Column) -> Column:
    """Text to int: a decimal part is cut off, anything else that is no int is NULL.

    Plain integers take the first branch; only the rest pays for the patterns.
    """
    truncated = F.concat(
        F.regexp_extract(col, _DECIMAL_TEXT, 1), F.lit("0"), F.regexp_extract(col, _DECIMAL_TEXT, 2)
    )
    has_decimals = col.rlike(_DECIMAL_TEXT) & col.contains(".")
    return F.coalesce(col.try_cast("int"), F.when(has_decimals, truncated.try_cast("int")))


def float_or_null(col: Column) -> Column:
    """Text to float32, NULL if it is no number."""
    return col.try_cast("float")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division as double; NULL for a zero or missing divisor."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))
