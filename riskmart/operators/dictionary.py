"""Indices of categories from a table of them, however many there are.

The dictionary is counted, ordered and numbered by Spark and joined to the rows; no list of categories reaches the driver. It numbers as
the indexer of ``create_pipeline`` does: by falling frequency, equal ones in the order of their texts, unknown ones behind the last.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.operators.running import totals_before
from riskmart.operators.skew import splittable


def category_dictionary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(feature, category, n, index)`` of the categories of all columns in one pass; missing values have none."""
    values = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "feature", "category")
    counts = values.filter(F.col("category").isNotNull()).groupBy("feature", "category").agg(F.count("*").alias("n"))
    numbered = totals_before(counts.withColumn("one", F.lit(1)), [F.desc("n"), F.asc("category")], ["one"], "feature")
    return numbered.select("feature", "category", "n", F.col("one_before").cast("double").alias("index"))


def dictionary_sizes(dictionary: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Number of categories by column: one row per column comes to the driver."""
    found = {r.feature: r.n for r in dictionary.groupBy("feature").agg(F.count("*").alias("n")).collect()}
    return {c: found.get(c, 0) for c in columns}


def indexed(df: DataFrame, dictionary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with ``<column>_idx``; missing and unknown values have the index behind the last category.

    Each column is a left join with its part of the dictionary, which Spark broadcasts when it is small and whose hot values it splits when not.
    """
    sizes = dictionary_sizes(dictionary, columns)
    for c in columns:
        own = dictionary.filter(F.col("feature") == c).select(F.col("category").alias("known"), F.col("index").alias("found"))
        df = (
            df.join(splittable(own), F.col(c).cast("string") == F.col("known"), "left")
            .withColumn(f"{c}_idx", F.coalesce("found", F.lit(float(sizes[c]))))
            .drop("known", "found")
        )
    return df


def sparse_slots(df: DataFrame, key: Sequence[str], sizes: Mapping[str, int], numeric: Sequence[str] = ()) -> DataFrame:
    """``(*key, slot, value)``: the non-zero slots of the assembled vector, from columns that ``indexed`` added.

    One-hot slots of the categorical columns come first, in their order, then the numbers. A row has as many entries as features at most, whatever the
    number of categories.
    """
    entries, start = [], 0
    for c, n in sizes.items():
        index = F.col(f"{c}_idx")
        entries.append(F.when(index < n, F.struct((index + start).cast("long").alias("slot"), F.lit(1.0).alias("value"))))
        start += n
    for i, c in enumerate(numeric):
        value = F.col(c).cast("double")
        entries.append(F.when(value != 0, F.struct(F.lit(start + i).cast("long").alias("slot"), value.alias("value"))))
    return df.select(*key, F.explode(F.array_compact(F.array(*entries))).alias("entry")).select(*key, "entry.slot", "entry.value")
