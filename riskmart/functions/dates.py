"""Date parsing and calendar keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskmart.functions.text import strip_whitespace

# The text form of a date, and the first and last day that count as
# valid (the range of a nanosecond timestamp; 31/12/9999 is a bad date).
DAY_MONTH_YEAR = r"^\d{1,2}/\d{1,2}/\d{4}$"
FIRST_DAY, LAST_DAY = "1677-09-22", "2262-04-11"


def parse_day_month_year(col: Column) -> Column:
    """Strict day/month/year, NULL if the text is anything else.

    The pattern guards the parser, which alone would accept longer day or month parts.
    """
    text = strip_whitespace(col)
    day = F.try_to_date(text, "d/M/yyyy")
    in_range = day.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date"))
    return F.when(text.rlike(DAY_MONTH_YEAR) & in_range, day)


def month_key(col: Column) -> Column:
    """Calendar month as ``yyyy-MM``, for a date or an ISO date text."""
    return F.date_format(F.try_to_date(col.cast("string")), "yyyy-MM")
