"""String cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts the CSV reader treats as missing (the pandas defaults).
NA_TOKENS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)


def na_to_null(col: Column) -> Column:
    """Missing-value tokens become NULL; other texts stay as they are."""
    return F.when(~col.isin(*NA_TOKENS), col)


def strip_whitespace(col: Column) -> Column:
    """Strip every kind of whitespace, where ``trim`` would strip only spaces."""
    return F.regexp_replace(col, r"(?U)^\s+|\s+$", "")


def without_underscores(col: Column) -> Column:
    return F.replace(col.cast("string"), F.lit("_"), F.lit(""))


def blank_placeholders(col: Column, placeholders: Sequence[str]) -> Column:
    """NULL where the space-trimmed text is a placeholder, else the untrimmed original."""
    return F.when(F.trim(col).isin(*placeholders), F.lit(None)).otherwise(col)
