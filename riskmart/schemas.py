"""Declared types of the four sources.

Columns that arrive dirty are strings and are cleaned later; nothing is inferred by
scanning the data. Columns a file has beyond these pass through as strings.
"""

from __future__ import annotations

from pyspark.sql import types as T

CLICK_FEATURES = tuple(f"fe_{i}" for i in range(1, 21))

# Column names the cleaning rules apply to.
FINANCIAL_NUMBERS = (
    "Annual_Income",
    "Monthly_Inhand_Salary",
    "Num_of_Loan",
    "Outstanding_Debt",
    "Total_EMI_per_month",
    "Amount_invested_monthly",
    "Monthly_Balance",
)
FINANCIAL_CATEGORIES = ("Credit_Mix", "Payment_of_Min_Amount", "Payment_Behaviour")
NON_NEGATIVE_FINANCIALS = ("Annual_Income", "Monthly_Inhand_Salary", "Outstanding_Debt")
LOAN_AMOUNTS = ("loan_amt", "due_amt", "paid_amt", "overdue_amt")
DATE_COLUMNS = ("snapshot_date", "loan_start_date")


def _schema(strings: tuple[str, ...], doubles: tuple[str, ...] = ()) -> T.StructType:
    fields = [T.StructField(name, T.StringType()) for name in strings]
    fields += [T.StructField(name, T.DoubleType()) for name in doubles]
    return T.StructType(fields)


SOURCES = {
    "attributes": _schema(("Customer_ID", "Name", "Age", "SSN", "Occupation", "snapshot_date")),
    "financials": _schema(
        ("Customer_ID", *FINANCIAL_NUMBERS, *FINANCIAL_CATEGORIES, "Credit_History_Age", "snapshot_date")
    ),
    "loan_daily": _schema(("loan_id", "Customer_ID", "loan_start_date", "snapshot_date"), LOAN_AMOUNTS),
    "clickstream": _schema(("Customer_ID", "snapshot_date"), CLICK_FEATURES),
}
