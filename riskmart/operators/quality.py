"""Cleaning rules, quality flags and removal of flagged customers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.functions import blank_placeholders, float_or_null, int_or_null, without_underscores
from riskmart.operators.skew import splittable
from riskmart.schemas import (
    FINANCIAL_CATEGORIES,
    FINANCIAL_NUMBERS,
    LOAN_AMOUNTS,
    NON_NEGATIVE_FINANCIALS,
)

ISSUE = "data_quality_issue"
CUSTOMER = "Customer_ID"

# Placeholder texts, the accepted age range and the form of an SSN.
OCCUPATION_PLACEHOLDERS = ("_______", "_")
CATEGORY_PLACEHOLDERS = ("_______", "_", "NM")
MIN_AGE, MAX_AGE = 18, 100
SSN_FORM = r"^\d{3}-\d{2}-\d{4}$"


def _flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(condition, 1).otherwise(0)


def clean_attributes(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "Occupation": blank_placeholders(F.col("Occupation"), OCCUPATION_PLACEHOLDERS),
            "Age": int_or_null(without_underscores(F.col("Age"))),
        }
    )


def flag_attributes(cleaned: DataFrame) -> DataFrame:
    """A missing age passes; a missing SSN does not."""
    bad_age = (F.col("Age") < MIN_AGE) | (F.col("Age") > MAX_AGE)
    good_ssn = F.coalesce(F.trim("SSN").rlike(SSN_FORM), F.lit(False))
    return cleaned.withColumns(
        {"age_flag": _flag(bad_age), "ssn_flag": _flag(~good_ssn), ISSUE: _flag(bad_age | ~good_ssn)}
    )


def clean_financials(
    df: DataFrame,
    categories: Sequence[str] = FINANCIAL_CATEGORIES,
    numbers: Sequence[str] = FINANCIAL_NUMBERS,
) -> DataFrame:
    return df.withColumns(
        {c: blank_placeholders(F.col(c), CATEGORY_PLACEHOLDERS) for c in categories}
        | {c: float_or_null(without_underscores(F.col(c))) for c in numbers}
    )


def flag_negative(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Flag rows where any of the columns is below zero; missing values pass."""
    return df.withColumn(ISSUE, _flag(reduce(lambda a, b: a | b, [F.col(c) < 0 for c in columns])))


def flag_financials(cleaned: DataFrame) -> DataFrame:
    return flag_negative(cleaned, NON_NEGATIVE_FINANCIALS)


def flag_loans(df: DataFrame) -> DataFrame:
    return flag_negative(df, LOAN_AMOUNTS)


def flagged_customers(*flagged: DataFrame) -> DataFrame:
    """Distinct customers with at least one flagged row in any of the tables."""
    ids = [df.filter(F.col(ISSUE) == 1).select(CUSTOMER) for df in flagged]
    return reduce(DataFrame.union, ids).distinct()


def remove_flagged(df: DataFrame, flagged: DataFrame) -> DataFrame:
    """Drop every row of a flagged customer; rows without a customer stay.

    No hint: Spark broadcasts ``flagged`` only when its size, from file statistics or
    measured at run time, is under the session's threshold. Otherwise this is a sort-merge
    anti join whose large partitions AQE splits.
    """
    return df.join(splittable(flagged), CUSTOMER, "left_anti")


# One word of a filter holds 64 bits; a table of so many words is broadcast at most.
WORD_BITS, MOST_WORDS = 64, 1 << 20


def filter_words(n_flagged: int) -> int:
    """Words of a Bloom filter with about eight bits per flagged customer, a power of two up to ``MOST_WORDS``."""
    return min(MOST_WORDS, 1 << max(6, (n_flagged * 8 // WORD_BITS).bit_length()))


def _place(customer: Column, n_words: int) -> tuple[Column, Column]:
    """Word of a customer, and the four bits of it that a member has set."""
    word = F.pmod(F.xxhash64(customer), F.lit(n_words))
    bits = F.xxhash64(customer, F.lit(1))
    one = F.lit(1).cast("long")
    single = [F.call_function("shiftleft", one, F.shiftrightunsigned(bits, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(4)]
    return word, reduce(lambda a, b: a.bitwiseOR(b), single)


def flagged_filter(flagged: DataFrame, n_words: int) -> DataFrame:
    """``(word, bits)``: a Bloom filter of the flagged customers as a table of at most ``n_words`` rows."""
    word, bits = _place(F.col(CUSTOMER), n_words)
    return flagged.select(word.alias("word"), bits.alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def remove_flagged_split(df: DataFrame, flagged: DataFrame, n_flagged: int) -> DataFrame:
    """As ``remove_flagged`` for a set too large to broadcast: rows of surely clean customers stay where they are.

    The filter is broadcast, its size bounded by ``MOST_WORDS``. Rows of possible members, the flagged and a few per cent more, are shuffled and
    meet the exact anti join. A larger set sends more rows there and changes nothing else.
    """
    n_words = filter_words(n_flagged)
    members = flagged.select(F.col(CUSTOMER).cast(df.schema[CUSTOMER].dataType).alias(CUSTOMER))
    word, bits = _place(F.col(CUSTOMER), n_words)
    known = F.broadcast(flagged_filter(members, n_words).select(F.col("word").alias("_word"), F.col("bits").alias("_bits")))
    judged = df.withColumn("_own", bits).join(known, word == F.col("_word"), "left")
    possible = F.coalesce(F.col("_bits").bitwiseAND(F.col("_own")) == F.col("_own"), F.lit(False))
    clean, suspect = (judged.filter(c).select(*df.columns) for c in (~possible, possible))
    return clean.unionByName(suspect.join(splittable(members), CUSTOMER, "left_anti").select(*df.columns))
