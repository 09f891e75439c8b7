"""Column expressions. All are built-in, code-generated and safe under ANSI mode."""

from riskmart.functions.dates import month_key, parse_day_month_year
from riskmart.functions.numbers import float_or_null, int_or_null, ratio
from riskmart.functions.text import blank_placeholders, na_to_null, strip_whitespace, without_underscores

__all__ = [
    "blank_placeholders",
    "float_or_null",
    "int_or_null",
    "month_key",
    "na_to_null",
    "parse_day_month_year",
    "ratio",
    "strip_whitespace",
    "without_underscores",
]
