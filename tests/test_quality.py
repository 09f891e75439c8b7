from conftest import values

from riskmart.operators import quality
from riskmart.plans.silver import clean_tables, remove_flagged_customers


def attributes(spark, rows):
    return spark.createDataFrame(rows, "Customer_ID string, Age string, SSN string, Occupation string")


GOOD_SSN = "123-45-6789"


def test_age_and_ssn_flags(spark):
    rows = [(age, age, GOOD_SSN, "x") for age in ("17", "18", "100", "101", "-500", "abc", "17.9")]
    rows += [(f"ssn {s}", "30", s, "x") for s in (f" {GOOD_SSN} ", "#F%$D@*&8", "123456789")]
    rows.append(("no ssn", "30", None, "x"))
    flagged = quality.flag_attributes(quality.clean_attributes(attributes(spark, rows)))
    got = {r.Customer_ID: (r.age_flag, r.ssn_flag, r.data_quality_issue) for r in flagged.collect()}
    assert got == {
        "17": (1, 0, 1),
        "18": (0, 0, 0),
        "100": (0, 0, 0),
        "101": (1, 0, 1),
        "-500": (1, 0, 1),
        "abc": (0, 0, 0),
        "17.9": (1, 0, 1),
        f"ssn  {GOOD_SSN} ": (0, 0, 0),
        "ssn #F%$D@*&8": (0, 1, 1),
        "ssn 123456789": (0, 1, 1),
        "no ssn": (0, 1, 1),
    }


def test_negative_flag_ignores_zero_and_missing(spark):
    df = spark.createDataFrame([(-0.01, 1.0), (0.0, 0.0), (None, None), (None, -1.0)], "a double, b double")
    flagged = quality.flag_negative(df, ["a", "b"])
    assert [r.data_quality_issue for r in flagged.collect()] == [1, 0, 0, 1]


def bronze(spark):
    columns = ", ".join(f"{c} string" for c in (*quality.FINANCIAL_NUMBERS, *quality.FINANCIAL_CATEGORIES))
    numbers = len(quality.FINANCIAL_NUMBERS)

    def financial(customer, values):
        return (customer, *(values + ["1"] * (numbers - len(values))), "NM", "_", "Good")

    balance_only = ["1"] * (numbers - 1) + ["-5"]
    return {
        "attributes": attributes(
            spark, [("ok", "30", GOOD_SSN, "_"), ("young", "9_", GOOD_SSN, "x"), (None, "30", GOOD_SSN, "x")]
        ),
        "financials": spark.createDataFrame(
            [financial("ok", ["__100__"]), financial("poor", ["_-1"]), financial("ok", balance_only)],
            f"Customer_ID string, {columns}",
        ),
        "loan_daily": spark.createDataFrame(
            [("ok", "l1", 1.0, 1.0, 1.0, 1.0), ("neg", "l2", 1.0, 1.0, -1.0, 0.0), ("neg", "l2", 1.0, 1.0, 1.0, 0.0)]
            + [("young", "l3", 1.0, 1.0, 1.0, 0.0), (None, "l4", 1.0, 1.0, None, 0.0)],
            "Customer_ID string, loan_id string, loan_amt double, due_amt double, paid_amt double, overdue_amt double",
        ),
        "clickstream": spark.createDataFrame([("ok", 1), ("neg", 2), ("poor", 3), (None, 4)], "Customer_ID string, n int"),
    }


def test_cleaned_financials(spark):
    cleaned = clean_tables(bronze(spark)).tables["financials"]
    row = cleaned.filter("Annual_Income = 100").first()
    assert (row.Credit_Mix, row.Payment_of_Min_Amount, row.Payment_Behaviour) == (None, None, "Good")
    assert dict(cleaned.dtypes)["Monthly_Balance"] == "float"


def test_one_bad_row_removes_the_customer_everywhere(spark):
    tables, flagged = clean_tables(bronze(spark))
    assert values(flagged) == [("neg",), ("poor",), ("young",)]
    kept = remove_flagged_customers(tables, flagged)
    assert values(kept["attributes"], "Customer_ID") == [(None,), ("ok",)]
    assert values(kept["financials"], "Customer_ID") == [("ok",), ("ok",)]
    assert values(kept["loan_daily"], "Customer_ID") == [(None,), ("ok",)]
    assert values(kept["clickstream"], "Customer_ID") == [(None,), ("ok",)]
    for df in kept.values():
        assert not {c for c in df.columns if "flag" in c or "issue" in c}
