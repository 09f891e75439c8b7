"""History features against the plain definition: pair rows with label rows, then aggregate."""

import datetime as dt
import math
import random

import pytest
from conftest import day, values
from pyspark.sql import functions as F

from riskmart.operators import history

COLUMNS = ("x", "y")
START = dt.date(2023, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    """Customer 0 and loan 0 hold a third of the rows; ids may be missing or shared."""
    rng = random.Random(7)

    def key(n):
        return rng.choice([0, rng.randrange(n), rng.choice([None, rng.randrange(n)])])

    def date(span):
        return rng.choice([None] + [START + dt.timedelta(rng.randrange(span)) for _ in range(15)])

    def number():
        return rng.choice([None] + [1e6 + rng.random() for _ in range(6)])

    labels = {(key(12), key(9)): date(60) for _ in range(80)}
    labels = spark.createDataFrame(
        [(loan, customer, cut) for (loan, customer), cut in labels.items()],
        "loan_id int, Customer_ID int, prediction_date date",
    )
    daily = spark.createDataFrame(
        [(key(12), key(9), date(60), number(), number(), number()) for _ in range(400)],
        "loan_id int, Customer_ID int, snapshot_date date, paid_amt double, due_amt double, overdue_amt double",
    )
    clicks = spark.createDataFrame(
        [(i, key(9), date(60), number(), number()) for i in range(400)],
        "click int, Customer_ID int, snapshot_date date, x double, y double",
    )
    for name, df in {"labels": labels, "daily": daily, "clicks": clicks}.items():
        df.createOrReplaceTempView(name)
    return labels, daily, clicks


COMPARE = {"inclusive": "<=", "exclusive": "<"}


def close(got, expected):
    assert len(got) == len(expected)
    for left, right in zip(got, expected, strict=True):
        for a, b in zip(left, right, strict=True):
            same = a == b if a is None or b is None or not isinstance(a, float) else math.isclose(a, b, rel_tol=1e-6)
            assert same, (left, right)


@pytest.mark.parametrize("end", COMPARE)
def test_weight_is_the_number_of_pairs(spark, tables, end):
    labels, daily, clicks = tables
    got = history.clickstream_history(clicks, labels, end).select("click", history.WEIGHT)
    want = spark.sql(
        f"""select click, count(*) from clicks c join labels l on c.Customer_ID = l.Customer_ID
            where snapshot_date {COMPARE[end]} prediction_date group by click"""
    )
    assert values(got) == values(want)
    got = history.loan_history(daily, labels, end).agg(F.sum(history.WEIGHT))
    want = spark.sql(
        f"""select count(*) from daily d join labels l on d.loan_id = l.loan_id
            where snapshot_date {COMPARE[end]} prediction_date"""
    )
    assert values(got) == values(want)


@pytest.mark.parametrize("end", COMPARE)
@pytest.mark.parametrize("grain", ["customer", "loan"])
def test_loan_sums(spark, tables, grain, end):
    labels, daily, _ = tables
    keys = "d.Customer_ID" if grain == "customer" else "d.loan_id, d.Customer_ID"
    same = "" if grain == "customer" else "and d.Customer_ID = l.Customer_ID"
    got = history.loan_agg(daily, labels, grain, end).drop("hist_Loan_Payment_Ratio")
    want = spark.sql(
        f"""select {keys}, sum(paid_amt), sum(due_amt), sum(overdue_amt) from daily d
            join labels l on d.loan_id = l.loan_id {same}
            where snapshot_date {COMPARE[end]} prediction_date group by {keys}"""
    )
    close(values(got), values(want))


@pytest.mark.parametrize("end", COMPARE)
@pytest.mark.parametrize("grain", ["customer", "loan"])
def test_click_statistics(spark, tables, grain, end):
    """The values lie near a million and vary by one, where plain sums of squares fail."""
    labels, _, clicks = tables
    spine, keys = "labels", "c.Customer_ID"
    if grain == "loan":
        spine, keys = "(select distinct Customer_ID, prediction_date from labels)", "c.Customer_ID, prediction_date"
    got = history.clickstream_agg(clicks, labels, grain, COLUMNS, end)
    want = spark.sql(
        f"""select {keys}, avg(x), avg(y), stddev_samp(x), stddev_samp(y)
            from clicks c join {spine} l on c.Customer_ID = l.Customer_ID
            where snapshot_date {COMPARE[end]} prediction_date group by {keys}"""
    )
    close(values(got), values(want))


def test_unknown_options_are_errors(tables):
    labels, daily, clicks = tables
    with pytest.raises(ValueError, match="grain"):
        history.loan_agg(daily, labels, "month")
    with pytest.raises(ValueError, match="history_end"):
        history.clickstream_agg(clicks, labels, columns=COLUMNS, history_end="never")


def test_payment_ratio(spark):
    labels = spark.createDataFrame([(i, i, day("2023-01-31")) for i in range(4)], "loan_id int, Customer_ID int, prediction_date date")
    daily = spark.createDataFrame(
        [(0, 0, 5.0, 0.0), (1, 1, 5.0, None), (2, 2, 50.0, 100.0), (3, 3, None, 100.0)],
        "loan_id int, Customer_ID int, paid_amt double, due_amt double",
    ).withColumns({"snapshot_date": F.lit("2023-01-01").cast("date"), "overdue_amt": F.lit(0.0)})
    got = history.loan_agg(daily, labels).select("Customer_ID", "hist_Loan_Payment_Ratio")
    assert values(got) == [(0, 1.0), (1, 1.0), (2, 0.5), (3, None)]


def test_mean_skips_missing_and_one_value_has_no_deviation(spark):
    labels = spark.createDataFrame([(1, 1, day("2023-01-31"))], "loan_id int, Customer_ID int, prediction_date date")
    clicks = spark.createDataFrame(
        [(1, day("2023-01-01"), 4.0, None), (1, day("2023-01-02"), None, None)],
        "Customer_ID int, snapshot_date date, x double, y double",
    )
    for grain in ("customer", "loan"):
        row = history.clickstream_agg(clicks, labels, grain, COLUMNS).first()
        assert (row.x_mean, row.x_std, row.y_mean, row.y_std) == (4.0, None, None, None)


def test_infinite_and_not_a_number_spread_only_forward(spark):
    labels = spark.createDataFrame(
        [(1, 1, day("2023-01-10")), (2, 1, day("2023-01-31"))], "loan_id int, Customer_ID int, prediction_date date"
    )
    clicks = spark.createDataFrame(
        [(1, day("2023-01-01"), 4.0, 1.0), (1, day("2023-01-20"), float("nan"), float("inf"))],
        "Customer_ID int, snapshot_date date, x double, y double",
    )
    early, late = history.clickstream_agg(clicks, labels, "loan", COLUMNS).orderBy("prediction_date").collect()
    assert (early.x_mean, early.y_mean) == (4.0, 1.0)
    assert math.isnan(late.x_mean) and not math.isfinite(late.y_mean)


def test_predictions_meet_click_days_without_room_for_moments(spark):
    """Predictions bring narrow rows, and none for a customer without clicks."""
    clicks = spark.createDataFrame([(1, START, 2.0)], "Customer_ID int, snapshot_date date, x double")
    labels = spark.createDataFrame([(1, START), (2, START), (None, START)], "Customer_ID int, prediction_date date")
    together = history._days_and_predictions(history.click_days(clicks, ["x"]), labels, "inclusive")
    assert set(together.columns) == {"Customer_ID", "day", "prediction_date", history.IS_CLICK_DAY, history.WEIGHT, history.MOMENTS}
    assert [r.Customer_ID for r in together.filter("prediction_date is not null").collect()] == [1]
    for grain in ("customer", "loan"):
        found = history.clickstream_agg(clicks, labels, grain, ["x"]).collect()
        assert [(r.Customer_ID, r.x_mean, r.x_std) for r in found] == [(1, 2.0, None)]
