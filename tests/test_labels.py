import pytest
from conftest import day, values

from riskmart.operators import labels, metrics

SCHEMA = "loan_id string, Customer_ID string, loan_start_date date, snapshot_date date, overdue_amt double"


def daily(spark, *rows):
    return spark.createDataFrame([(l, c, day(s), day(d), o) for l, c, s, d, o in rows], SCHEMA)


@pytest.mark.parametrize("pm, wm, expected", [(1, 12, 11), (1, 6, 6), (13, 12, 0), (0, 12, 12), (12, 1, 0), (6, 6, 6)])
def test_window_is_clamped_to_the_loan_life(pm, wm, expected):
    assert labels.effective_window(pm, wm, 12) == expected


def test_months_are_added_in_two_clamped_steps(spark):
    loans = spark.createDataFrame([("a", "c", day("2023-01-31"))], "loan_id string, Customer_ID string, start_date date")
    row = labels.label_windows(loans, 1, 12).first()
    assert row.prediction_date == day("2023-02-28")
    assert row.label_window_end == day("2024-01-28")


def test_both_ends_of_the_window_count(spark):
    start = "2023-01-15"  # prediction on 2023-02-15, window end on 2024-01-15
    df = daily(
        spark,
        ("on prediction", "c", start, "2023-02-15", 1.0),
        ("on end", "c", start, "2024-01-15", 1.0),
        ("before", "c", start, "2023-02-14", 1.0),
        ("after", "c", start, "2024-01-16", 1.0),
        ("nothing due", "c", start, "2023-06-01", 0.0),
        ("unknown due", "c", start, "2023-06-01", None),
        ("no start", "c", None, "2023-06-01", 5.0),
        ("twice", "c", start, "2023-06-01", 5.0),
        ("twice", "c", start, "2023-06-01", 5.0),
    )
    got = {r.loan_id: r.label for r in labels.label_store(df).collect()}
    assert got == {"on prediction": 1, "on end": 1, "before": 0, "after": 0, "nothing due": 0, "unknown due": 0, "twice": 1}


def test_first_known_start_date_counts(spark):
    df = daily(spark, ("a", "c", None, "2023-01-01", 0.0), ("a", "c", "2023-03-01", "2023-04-01", 0.0), ("a", "c", "2023-02-01", "2023-04-01", 0.0))
    assert values(labels.loan_info(df)) == [("a", "c", day("2023-02-01"))]


def test_shared_loan_id_labels_every_customer(spark):
    df = daily(
        spark,
        ("a", "c1", "2023-01-15", "2023-06-01", 5.0),
        ("a", "c2", "2020-01-15", "2020-06-01", 0.0),
        ("b", "c3", "2020-01-15", "2020-06-01", 0.0),
    )
    store = labels.label_store(df)
    assert values(store, "Customer_ID", "label") == [("c1", 1), ("c2", 1), ("c3", 0)]
    assert metrics.shared_loans(store).first().n_shared_loans == 1
    assert values(metrics.label_distribution(store)) == [(0, 1), (1, 2)]


def test_missing_loan_id_keeps_its_row_and_never_defaults(spark):
    df = daily(spark, (None, "c1", "2023-01-15", "2023-06-01", 5.0), (None, "c2", "2023-01-15", "2023-06-01", 5.0))
    assert values(labels.label_store(df), "loan_id", "Customer_ID", "label") == [(None, "c1", 0), (None, "c2", 0)]


def test_schema(spark):
    store = labels.label_store(daily(spark, ("a", "c", "2023-01-15", "2023-06-01", 5.0)))
    assert store.dtypes == [("Customer_ID", "string"), ("loan_id", "string"), ("prediction_date", "date"), ("label", "int")]
