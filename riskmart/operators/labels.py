"""Label store: does a loan go overdue within a window after its prediction date?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskmart.config import LABEL_WINDOW_MONTHS, MAX_LOAN_MONTHS, PREDICTION_MONTHS
from riskmart.operators.skew import splittable


def effective_window(
    prediction_months: int = PREDICTION_MONTHS,
    label_window_months: int = LABEL_WINDOW_MONTHS,
    max_loan_months: int = MAX_LOAN_MONTHS,
) -> int:
    """Window length such that prediction and window together fit into the loan's life."""
    return min(label_window_months, max(0, max_loan_months - prediction_months))


def loan_info(loan_daily: DataFrame) -> DataFrame:
    """First start date per (loan, customer); loans without one are left out."""
    return (
        loan_daily.groupBy("loan_id", "Customer_ID")
        .agg(F.min("loan_start_date").alias("start_date"))
        .filter(F.col("start_date").isNotNull())
    )


def label_windows(
    loans: DataFrame,
    prediction_months: int = PREDICTION_MONTHS,
    label_window_months: int = LABEL_WINDOW_MONTHS,
    max_loan_months: int = MAX_LOAN_MONTHS,
) -> DataFrame:
    """Add prediction date and window end. Months are added in two steps, each clamped
    to the month's end, so the end may differ from adding the sum."""
    window = effective_window(prediction_months, label_window_months, max_loan_months)
    return loans.withColumn("prediction_date", F.add_months("start_date", prediction_months)).withColumn(
        "label_window_end", F.add_months("prediction_date", window)
    )


def default_events(windows: DataFrame, loan_daily: DataFrame) -> DataFrame:
    """Distinct loans overdue on some day of a window of theirs, both ends included.

    Both sides are reduced to distinct days before they meet, so one loan brings at most
    as many rows as there are calendar days however often it occurs. The spans are shuffled once
    more for the join, so its tasks hold none of the tables that the steps before keep.
    """
    overdue = (
        loan_daily.filter((F.col("overdue_amt") > 0) & F.col("snapshot_date").isNotNull())
        .select("loan_id", "snapshot_date")
        .distinct()
    )
    spans = windows.select(
        F.col("loan_id").alias("span_loan"), "prediction_date", "label_window_end"
    ).distinct()
    in_window = (F.col("loan_id") == F.col("span_loan")) & F.col("snapshot_date").between(
        F.col("prediction_date"), F.col("label_window_end")
    )
    return overdue.join(splittable(spans), in_window, "left_semi").select("loan_id").distinct()


def label_store(
    loan_daily: DataFrame,
    prediction_months: int = PREDICTION_MONTHS,
    label_window_months: int = LABEL_WINDOW_MONTHS,
    max_loan_months: int = MAX_LOAN_MONTHS,
    loans: DataFrame | None = None,
) -> DataFrame:
    """One row per loan and customer: Customer_ID, loan_id, prediction_date, label.

    Loans are read from the daily table unless a table of (loan_id, Customer_ID,
    loan_start_date) is given. A loan id shared by customers is labelled for all of them.

    Rows without a loan id match no event and get label 0 apart from the others. Both uses
    of the remaining windows then have the same plan, and Spark shuffles them once.
    """
    source = loan_daily if loans is None else loans
    months = (prediction_months, label_window_months, max_loan_months)
    has_id = F.col("loan_id").isNotNull()
    windows = label_windows(loan_info(source.filter(has_id)), *months)
    unknown = label_windows(loan_info(source.filter(~has_id)), *months)
    defaulted = default_events(windows, loan_daily).withColumn("defaulted", F.lit(1))
    labelled = windows.join(splittable(defaulted), "loan_id", "left").withColumn(
        "label", F.coalesce("defaulted", F.lit(0))
    )
    return labelled.unionByName(unknown.withColumn("label", F.lit(0)), allowMissingColumns=True).select(
        "Customer_ID", "loan_id", "prediction_date", "label"
    )
