from conftest import day, values
from pyspark.sql import functions as F

from riskmart.operators import features, quality
from riskmart.schemas import CLICK_FEATURES

LABELS = "Customer_ID int, loan_id int, prediction_date date, label int"


def financials(spark, *rows):
    numbers = {c: F.lit(1.0).cast("float") for c in quality.FINANCIAL_NUMBERS}
    df = spark.createDataFrame([(c, day(d), h) for c, d, h in rows], "Customer_ID int, snapshot_date date, Credit_History_Age string")
    return df.withColumns(numbers | {"year": F.year("snapshot_date"), "month": F.month("snapshot_date")})


def attributes(spark, *rows):
    df = spark.createDataFrame([(c, day(d), a) for c, d, a in rows], "Customer_ID int, snapshot_date date, Age int")
    return df.withColumns({"year": F.year("snapshot_date"), "month": F.month("snapshot_date")})


def test_ratios_and_their_types(spark):
    df = financials(spark, (1, "2023-01-01", "2 Years and 3 Months"), (2, "2023-01-01", None))
    salary = F.when(F.col("Customer_ID") == 1, 400.0).otherwise(0.0).cast("float")
    df = features.financial_features(df.withColumn("Monthly_Inhand_Salary", salary))
    kinds = dict(df.dtypes)
    assert kinds["Monthly_Surplus"] == "float" and kinds["DTI"] == kinds["Debt_to_Annual_Income"] == "double"
    columns = ("Credit_History_Months", "DTI", "Savings_Ratio", "Monthly_Surplus", "Debt_to_Annual_Income")
    assert values(df, *columns) == [(0, None, None, -2.0, 1.0), (27, 0.0025, 0.0025, 398.0, 1.0)]


def gold(spark, grain="customer", history_end="inclusive"):
    """Customer 1 has two loans, ties in both snapshots; 2 lacks all but attributes; 3 lacks those."""
    labels = spark.createDataFrame(
        [
            (1, 10, day("2023-02-01"), 0),
            (1, 11, day("2023-06-01"), 1),
            (2, 20, day("2023-02-01"), 0),
            (3, 30, day("2023-02-01"), 0),
        ],
        LABELS,
    )
    daily = spark.createDataFrame(
        [(10, 1, day("2023-01-15"), 5.0), (10, 1, day("2023-03-01"), 7.0), (11, 1, day("2023-06-01"), 11.0)],
        "loan_id int, Customer_ID int, snapshot_date date, paid_amt double",
    ).withColumns({"due_amt": F.lit(10.0), "overdue_amt": F.lit(0.0)})
    clicks = spark.createDataFrame(
        [(1, day("2023-01-01"), 1.0), (1, day("2023-03-01"), 4.0)], "Customer_ID int, snapshot_date date, x double"
    ).withColumns({c: F.col("x") for c in CLICK_FEATURES})
    return features.gold_features(
        labels,
        attributes(spark, (1, "2023-01-01", 30), (1, "2023-05-01", 31), (1, "2023-05-01", 32), (2, "2022-01-01", 40), (3, "2023-09-01", 50)),
        financials(spark, (1, "2023-05-01", "1 Years"), (1, "2023-05-01", "2 Years"), (3, "2023-01-01", "3 Years")),
        daily,
        clicks.drop("x"),
        grain,
        history_end,
    )


def test_customer_grain_repeats_the_customer_on_every_loan(spark):
    df = gold(spark)
    columns = ("loan_id", "Age", "Credit_History_Months", "hist_total_paid", "hist_Loan_Payment_Ratio", "fe_1_mean")
    ties = [(age, months) for age in (31, 32) for months in (12, 24)]
    # paid: 5 up to the first loan's date, 11 up to the second's; the first click counts for both loans.
    expected = [(loan, age, months, 16.0, 0.8, 2.0) for loan in (10, 11) for age, months in ties]
    assert values(df, *columns) == expected + [(20, 40, None, None, None, None)]
    assert df.columns[:6] == ["Customer_ID", "loan_id", "prediction_date", "label", "snapshot_date", "Age"]
    assert df.columns.count("year") == df.columns.count("snapshot_date") == 1


def test_loan_grain_uses_only_what_was_known(spark):
    columns = ("loan_id", "Age", "Credit_History_Months", "hist_total_paid", "fe_1_mean", "fe_1_std")
    got = values(gold(spark, "loan"), *columns)
    std = 4.5**0.5
    assert got[0] == (10, 30, None, 5.0, 1.0, None)
    assert got[1:5] == [(11, age, months, 11.0, 2.5, std) for age in (31, 32) for months in (12, 24)]
    assert got[5] == (20, 40, None, None, None, None)
    assert gold(spark, "loan").columns == gold(spark).columns


def test_exclusive_history_leaves_out_the_prediction_day(spark):
    assert values(gold(spark, history_end="exclusive").filter("loan_id = 11"), "hist_total_paid")[0] == (5.0,)
    assert values(gold(spark, "loan", "exclusive").filter("loan_id = 11"), "hist_total_paid")[0] == (None,)
