"""Feature engineering on financial snapshots and assembly of the feature matrix."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.functions import ratio
from riskmart.operators.asof import asof_latest
from riskmart.operators.history import CUSTOMER, check_grain, clickstream_agg, clickstream_agg_of_days, loan_agg
from riskmart.operators.skew import splittable
from riskmart.sources.partitions import PARTITION_KEYS


def credit_history_months(text: Column, plural_only: bool = True) -> Column:
    """Months in a text such as ``10 Years and 9 Months``; a missing part counts as 0.

    With ``plural_only`` the singular words are not recognised.
    """
    plural = "s" if plural_only else "s?"

    def part(unit: str) -> Column:
        digits = F.regexp_extract(text, rf"(\d+)\s+{unit}{plural}", 1)
        return F.coalesce(digits.try_cast("int"), F.lit(0))

    return part("Year") * 12 + part("Month")


def financial_features(financials: DataFrame, plural_only: bool = True) -> DataFrame:
    """Credit history length and affordability ratios; a zero divisor gives NULL."""
    salary, emi, invested = (
        F.col(c) for c in ("Monthly_Inhand_Salary", "Total_EMI_per_month", "Amount_invested_monthly")
    )
    return financials.withColumns(
        {
            "Credit_History_Months": credit_history_months(F.col("Credit_History_Age"), plural_only),
            "DTI": ratio(emi, salary),
            "Savings_Ratio": ratio(invested, salary),
            "Monthly_Surplus": salary - emi - invested,
            "Debt_to_Annual_Income": ratio(F.col("Outstanding_Debt"), F.col("Annual_Income")),
        }
    )


HAS_FINANCIALS = "_has_financials"


def gold_features(
    labels: DataFrame,
    attributes: DataFrame,
    financials: DataFrame,
    loan_daily: DataFrame,
    clickstream: DataFrame,
    grain: str = "customer",
    history_end: str = "inclusive",
    plural_only: bool = True,
    click_days: DataFrame | None = None,
) -> DataFrame:
    """Label rows with everything known about the customer at prediction time.

    ``loan_daily`` may be stored ``loan_days``, and ``click_days`` stored moments that stand for the clickstream.

    Label rows without an attributes snapshot drop out; other missing features are NULL.
    The feature tables share their key and are joined to each other first, a few rows per
    key and without a further shuffle, so the label table is shuffled once and its hot
    customers meet a single join, in which AQE can split them. By loan, the loans' sums are joined to the labels
    before, while these are narrow. What is worked out from single financial rows comes last there, so that no join moves it;
    by customer it is worked out once for all loans of each.
    """
    check_grain(grain)
    keys = [CUSTOMER] if grain == "customer" else [CUSTOMER, "prediction_date"]
    attributes_now = asof_latest(attributes, labels, grain, history_end)
    financials_now = asof_latest(financials, labels, grain, history_end).drop("snapshot_date", *PARTITION_KEYS)
    engineered = [c for c in financial_features(financials_now, plural_only).columns if c not in financials_now.columns]
    loans = loan_agg(loan_daily, labels, grain, history_end)
    if click_days is None:
        clicks = clickstream_agg(clickstream, labels, grain, history_end=history_end)
    else:
        clicks = clickstream_agg_of_days(click_days, labels, grain, history_end=history_end)

    found = financials_now.withColumn(HAS_FINANCIALS, F.lit(True))
    per_key = [found, loans, clicks] if grain == "customer" else [found, clicks]
    known = reduce(lambda left, right: left.join(right, keys, "left"), per_key, attributes_now)

    def worked_out(rows: DataFrame) -> DataFrame:
        features = financial_features(rows, plural_only)
        return features.withColumns({c: F.when(F.col(HAS_FINANCIALS), F.col(c)) for c in engineered}).drop(HAS_FINANCIALS)

    if grain == "customer":
        gold = labels.join(splittable(worked_out(known)), keys)
    else:
        gold = worked_out(labels.join(loans, ["loan_id", CUSTOMER], "left").join(splittable(known), keys))

    added = [*attributes_now.columns, *financials_now.columns, *engineered, *loans.columns, *clicks.columns]
    order = dict.fromkeys([CUSTOMER, *labels.columns, *added])
    return gold.select(*order)
