"""Counts and shares about each layer, as DataFrames."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUSTOMER = "Customer_ID"


def _customer_ids(tables: Mapping[str, DataFrame]) -> DataFrame:
    ids = [df.select(F.lit(name).alias("table_name"), CUSTOMER) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, ids)


def partition_distribution(calendar: DataFrame) -> DataFrame:
    """Rows per year and month, undated rows excluded."""
    return (
        calendar.filter(F.col("year").isNotNull() & F.col("month").isNotNull())
        .groupBy("year", "month")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy("year", "month")
    )


def label_distribution(labels: DataFrame) -> DataFrame:
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("n_loans"))


def flag_summary(tables: Mapping[str, DataFrame], flagged: DataFrame) -> DataFrame:
    """Flagged customers, customers in any table (a missing id counts as one), and the share."""
    seen = _customer_ids(tables).select(CUSTOMER, F.lit(0).alias("is_flagged"))
    marked = flagged.select(CUSTOMER, F.lit(1).alias("is_flagged"))
    return (
        seen.unionByName(marked)
        .groupBy(CUSTOMER)
        .agg(F.max("is_flagged").alias("is_flagged"))
        .agg(
            F.coalesce(F.sum("is_flagged"), F.lit(0)).alias("n_flagged"),
            F.count(F.lit(1)).alias("n_customers"),
        )
        .withColumn(
            "flagged_percent",
            F.coalesce(F.try_divide(F.col("n_flagged") * 100, F.col("n_customers")), F.lit(0.0)),
        )
    )


def removal_counts(tables: Mapping[str, DataFrame], flagged: DataFrame) -> DataFrame:
    """Rows of each table before and after the removal of flagged customers, in one pass."""
    per_customer = (
        _customer_ids(tables).groupBy("table_name", CUSTOMER).agg(F.count(F.lit(1)).alias("n"))
    )
    marked = per_customer.join(flagged.withColumn("gone", F.lit(1)), CUSTOMER, "left")
    return (
        marked.groupBy("table_name")
        .agg(
            F.sum("n").alias("rows_before"),
            F.sum(F.when(F.col("gone").isNull(), F.col("n")).otherwise(0)).alias("rows_after"),
        )
        .withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))
    )


def shared_loans(labels: DataFrame) -> DataFrame:
    """Number of loan ids that several customers carry; their events are counted for each."""
    return (
        labels.groupBy("loan_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > 1)
        .agg(F.count(F.lit(1)).alias("n_shared_loans"))
    )
