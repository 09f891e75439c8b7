"""Payment and clickstream history up to the prediction dates, without pairing rows.

A dated row counts once for every label row of its key whose prediction date is not
earlier. Joining rows with label rows would produce exactly those pairs, which explodes
for a key with many of both. Here the number of pairs is a weight instead.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart.config import GRAINS, HISTORY_ENDS
from riskmart.functions import ratio
from riskmart.operators.skew import splittable
from riskmart.schemas import CLICK_FEATURES

CUSTOMER = "Customer_ID"
WEIGHT = "n_predictions"
IS_CLICK_DAY = "is_click_day"


def check_grain(grain: str) -> None:
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, not {grain!r}")


def history_cut(history_end: str = "inclusive") -> Column:
    """Last day that may feed a feature: the prediction day, or the day before it."""
    if history_end not in HISTORY_ENDS:
        raise ValueError(f"history_end must be one of {HISTORY_ENDS}, not {history_end!r}")
    day = F.col("prediction_date")
    return day if history_end == "inclusive" else F.date_sub(day, 1)


def prediction_intervals(labels: DataFrame, key: str, history_end: str = "inclusive") -> DataFrame:
    """The days of each key cut at its predictions, as rows (key, after, cut, n_predictions).

    Label rows are grouped by day first, so a key never has more intervals than there are
    calendar days, however many label rows it has.
    """
    per_day = (
        labels.select(key, history_cut(history_end).alias("cut"))
        .filter(F.col(key).isNotNull() & F.col("cut").isNotNull())
        .groupBy(key, "cut")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    later = Window.partitionBy(key).orderBy(F.desc("cut"))
    return per_day.select(
        F.col(key).alias("interval_key"),
        F.lead("cut").over(later).alias("after"),
        "cut",
        F.sum("n").over(later).alias(WEIGHT),
    )


def weighted_history(
    rows: DataFrame, labels: DataFrame, key: str, history_end: str = "inclusive"
) -> DataFrame:
    """Rows that precede some prediction of their key, with the number of such label rows.

    A row lies in one interval of its key at most, so the join never multiplies rows, and a
    hot key's rows can be spread over tasks.
    """
    intervals = splittable(prediction_intervals(labels, key, history_end))
    day = F.col("snapshot_date")
    inside = (day <= F.col("cut")) & (F.col("after").isNull() | (day > F.col("after")))
    return rows.join(intervals, (F.col(key) == F.col("interval_key")) & inside).select(*rows.columns, WEIGHT)


def loan_history(loan_daily: DataFrame, labels: DataFrame, history_end: str = "inclusive") -> DataFrame:
    """Daily loan rows up to the loan's prediction date, weighted by its label rows."""
    return weighted_history(loan_daily, labels, "loan_id", history_end)


def clickstream_history(clicks: DataFrame, labels: DataFrame, history_end: str = "inclusive") -> DataFrame:
    """Click rows up to a prediction of the customer, weighted by the qualifying loans."""
    return weighted_history(clicks, labels, CUSTOMER, history_end)


def _with_payment_ratio(totals: DataFrame) -> DataFrame:
    paid, due = F.col("hist_total_paid"), F.col("hist_total_due")
    return totals.withColumn(
        "hist_Loan_Payment_Ratio", F.when(due > 0, ratio(paid, due)).otherwise(F.lit(1.0))
    )


def loan_agg(
    loan_daily: DataFrame, labels: DataFrame, grain: str = "customer", history_end: str = "inclusive"
) -> DataFrame:
    """Sums of paid, due and overdue amounts, and the payment ratio.

    ``customer``: over all loans of the customer, each up to its own prediction date.
    ``loan``: per label row, over the loan's own rows. ``loan_daily`` may be rows of ``loan_days``.
    """
    check_grain(grain)
    amounts = AMOUNTS
    daily = loan_daily.select("loan_id", CUSTOMER, "snapshot_date", *amounts.values())
    if grain == "customer":
        weighted = loan_history(daily, labels, history_end)
        sums = [F.sum(F.col(WEIGHT) * F.col(c)).alias(name) for name, c in amounts.items()]
        return _with_payment_ratio(weighted.groupBy(CUSTOMER).agg(*sums))
    # Both sides come straight from a shuffle and the sums are shuffled once more, combined on the map side
    # first, so AQE may split a hot loan and later days are never moved again.
    cuts = splittable(labels.select("loan_id", CUSTOMER, history_cut(history_end).alias("cut")))
    own = splittable(daily.join(cuts, ["loan_id", CUSTOMER]).filter(F.col("snapshot_date") <= F.col("cut")))
    sums = [F.sum(c).alias(name) for name, c in amounts.items()]
    return _with_payment_ratio(own.groupBy("loan_id", CUSTOMER).agg(*sums))


AMOUNTS = {"hist_total_paid": "paid_amt", "hist_total_due": "due_amt", "hist_total_overdue_amount": "overdue_amt"}


def loan_days(loan_daily: DataFrame) -> DataFrame:
    """Amounts per loan, customer and day. Sums of sums are sums, so days of several batches merge by the same function."""
    sums = [F.sum(c).alias(c) for c in AMOUNTS.values()]
    return loan_daily.groupBy("loan_id", CUSTOMER, "snapshot_date").agg(*sums)


def merged_click_days(days: DataFrame, columns: Sequence[str] = CLICK_FEATURES) -> DataFrame:
    """Moments of days that came in parts: counts and sums add up, squared deviations are taken around the common mean."""
    merged = []
    for c in columns:
        whole = f"(sum({c}_s) over day_of / nullif(sum({c}_n) over day_of, 0))"
        off = f"({c}_s / nullif({c}_n, 0) - {c}_m)"
        merged.append((f"{c}_m", F.expr(whole.replace("over day_of", f"over (partition by {CUSTOMER}, day)")), off))
    centred = days.withColumns({name: mean for name, mean, _ in merged})
    parts = []
    for c, (_, _, off) in zip(columns, merged, strict=True):
        parts += [
            F.sum(f"{c}_n").alias(f"{c}_n"),
            F.sum(f"{c}_s").alias(f"{c}_s"),
            F.expr(f"sum({c}_q + {c}_n * {off} * {off}) as {c}_q"),
        ]
    return centred.groupBy(CUSTOMER, "day").agg(*parts).withColumn(IS_CLICK_DAY, F.lit(1))


def click_days(clicks: DataFrame, columns: Sequence[str] = CLICK_FEATURES) -> DataFrame:
    """Count, sum and squared deviations per customer and day, combined on the map side."""
    parts = []
    for c in columns:
        parts += [
            F.expr(f"count({c}) as {c}_n"),
            F.expr(f"sum({c}) as {c}_s"),
            F.expr(f"var_pop({c}) * count({c}) as {c}_q"),
        ]
    return (
        clicks.filter(F.col(CUSTOMER).isNotNull() & F.col("snapshot_date").isNotNull())
        .groupBy(CUSTOMER, F.col("snapshot_date").alias("day"))
        .agg(*parts)
        .withColumn(IS_CLICK_DAY, F.lit(1))
    )


MOMENTS = "moments"


def _days_and_predictions(days: DataFrame, labels: DataFrame, history_end: str) -> DataFrame:
    """Click days and prediction dates of each customer as rows of one table.

    Both are grouped by day, so a customer brings at most two rows per calendar day into a
    window over it, even one with a third of all clicks and loans. The moments are one column,
    which is null and takes no room in the rows of predictions; predictions of customers without clicks give no row and stay out.
    """
    clicked = splittable(days.select(CUSTOMER).distinct())
    predictions = (
        labels.filter(F.col(CUSTOMER).isNotNull() & F.col("prediction_date").isNotNull())
        .groupBy(CUSTOMER, "prediction_date")
        .agg(F.count(F.lit(1)).alias(WEIGHT))
        .withColumn("day", history_cut(history_end))
        .join(clicked, CUSTOMER, "left_semi")
    )
    moments = [c for c in days.columns if c not in (CUSTOMER, "day", IS_CLICK_DAY)]
    packed = days.select(CUSTOMER, "day", IS_CLICK_DAY, F.struct(*moments).alias(MOMENTS))
    return packed.unionByName(predictions, allowMissingColumns=True)


OF_CUSTOMER = f"over (partition by {CUSTOMER})"


def _customer_statistics(days: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each click day counts once per prediction on or after it."""
    later = Window.partitionBy(CUSTOMER).orderBy(F.desc("day")).rangeBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    weighted = (
        days.withColumn(WEIGHT, F.sum(WEIGHT).over(later))
        .filter(F.col(IS_CLICK_DAY).isNotNull() & (F.col(WEIGHT) > 0))
        .select(CUSTOMER, "day", WEIGHT, f"{MOMENTS}.*")
    )
    means = {
        f"{c}_mean": F.expr(
            f"try_divide(sum({WEIGHT} * {c}_s) {OF_CUSTOMER}, sum({WEIGHT} * {c}_n) {OF_CUSTOMER})"
        )
        for c in columns
    }
    # Squares are taken around the mean itself, so they do not cancel.
    totals = [F.expr(f"max({c}_mean) as {c}_mean") for c in columns]
    for c in columns:
        off = f"({c}_s / nullif({c}_n, 0) - {c}_mean)"
        totals.append(F.expr(f"sum({WEIGHT} * {c}_n) as {c}_n"))
        totals.append(F.expr(f"sum({WEIGHT} * ({c}_q + {c}_n * {off} * {off})) as {c}_q"))
    return (
        weighted.withColumns(means)
        .groupBy(CUSTOMER)
        .agg(*totals)
        .select(
            CUSTOMER,
            *[f"{c}_mean" for c in columns],
            *[F.expr(f"if({c}_n > 1, sqrt({c}_q / ({c}_n - 1)), null) as {c}_std") for c in columns],
        )
    )


def _loan_statistics(days: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Running statistics, read off at each prediction date.

    Running sums are taken of deviations from the customer's mean over all its days, which
    keeps their squares from cancelling. Both windows have one order, so the rows are sorted once.
    """
    whole = f"over (partition by {CUSTOMER} order by day range between unbounded preceding and unbounded following)"
    so_far = f"over (partition by {CUSTOMER} order by day range between unbounded preceding and current row)"
    centres, deviations = {}, {}
    for c in columns:
        total, count = (f"sum(if(abs({c}_s) < double('inf'), {c}_{part}, null)) {whole}" for part in "sn")
        off = f"({c}_s / nullif({c}_n, 0) - {c}_c)"
        centres[f"{c}_c"] = F.expr(f"coalesce(try_divide({total}, {count}), 0d)")
        deviations[f"{c}_a"] = F.expr(f"{c}_n * {off}")
        deviations[f"{c}_q"] = F.expr(f"{c}_q + {c}_n * {off} * {off}")
    running = [f"sum({IS_CLICK_DAY}) {so_far} as {IS_CLICK_DAY}"]
    for c in columns:
        running += [f"{c}_c", *[f"sum({c}_{part}) {so_far} as {c}_{part}" for part in "naq"]]
    means = [f"{c}_c + {c}_a / nullif({c}_n, 0) as {c}_mean" for c in columns]
    squares = {c: f"greatest({c}_q - {c}_a * {c}_a / {c}_n, 0d)" for c in columns}
    deviation = [f"if({c}_n > 1, sqrt({squares[c]} / ({c}_n - 1)), null) as {c}_std" for c in columns]
    return (
        days.select(CUSTOMER, "day", "prediction_date", IS_CLICK_DAY, f"{MOMENTS}.*")
        .withColumns(centres)
        .withColumns(deviations)
        .selectExpr(CUSTOMER, "prediction_date", *running)
        .filter(F.col("prediction_date").isNotNull() & (F.col(IS_CLICK_DAY) > 0))
        .selectExpr(CUSTOMER, "prediction_date", *means, *deviation)
    )


def clickstream_agg(
    clicks: DataFrame,
    labels: DataFrame,
    grain: str = "customer",
    columns: Sequence[str] = CLICK_FEATURES,
    history_end: str = "inclusive",
) -> DataFrame:
    """Mean and sample standard deviation of each feature over the history.

    ``customer``: every row counts once per loan predicted on or after it.
    ``loan``: one row per (Customer_ID, prediction_date) over the rows up to that date.
    Customers and dates without any history have no row.
    """
    return clickstream_agg_of_days(click_days(clicks, columns), labels, grain, columns, history_end)


def clickstream_agg_of_days(
    days: DataFrame,
    labels: DataFrame,
    grain: str = "customer",
    columns: Sequence[str] = CLICK_FEATURES,
    history_end: str = "inclusive",
) -> DataFrame:
    """The same from ``click_days``, such as a stored table of them, with one row per customer and day."""
    check_grain(grain)
    days = _days_and_predictions(days, labels, history_end)
    return _customer_statistics(days, columns) if grain == "customer" else _loan_statistics(days, columns)
