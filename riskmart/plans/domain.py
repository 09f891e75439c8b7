"""The benchmark tables seen as loan data.

orders are loans and financial snapshots, lineitem is the daily loan table, customer gives
the attributes, events the clickstream. What the tables lack (dirty texts, snapshot dates)
is derived row by row from their keys, so it grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.plans.silver import Cleaned, clean_tables
from riskmart.schemas import CLICK_FEATURES

# Events lie in January 2024; moved back by this many days they lie in January 1997,
# among the loans.
CLICK_SHIFT_DAYS = 9861
# Each customer has three attribute snapshots this many days apart.
SNAPSHOTS, SNAPSHOT_STEP = 3, 600


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _whole(amount: Column, divisor: int) -> Column:
    return F.floor(amount / divisor).cast("long")


def _decimal_text(cents: Column) -> Column:
    """Whole cents as a decimal text such as ``1234.05``; never a formatted double."""
    size = F.abs(cents)
    return F.concat(
        F.when(cents < 0, "-").otherwise(""),
        _whole(size, 100).cast("string"),
        F.lit("."),
        F.lpad((size % 100).cast("string"), 2, "0"),
    )


def loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("loan_id"),
        F.col("o_custkey").alias("Customer_ID"),
        F.to_date("o_orderdate").alias("loan_start_date"),
    )


def _loan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily loan rows before their amounts are worked out; most of these columns have few values."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("loan_id"),
        F.to_date("l_shipdate").alias("snapshot_date"),
        F.col("l_quantity").alias("loan_amt"),
        F.col("l_extendedprice").alias("due_amt"),
        F.col("l_discount").alias("discount"),
        (F.col("l_partkey") % 499 == 0).alias("wrong"),
        (F.col("l_returnflag") == "R").alias("late"),
    )


def _with_amounts(rows: DataFrame) -> DataFrame:
    price, discount = F.col("due_amt"), F.col("discount")
    paid = price * (1 - discount)
    known = ["loan_id", "snapshot_date", "loan_amt", "due_amt"]
    return rows.select(
        *known,
        F.when(F.col("wrong"), -paid).otherwise(paid).alias("paid_amt"),
        F.when(F.col("late"), price * discount).otherwise(0.0).alias("overdue_amt"),
        *[c for c in rows.columns if c not in (*known, "discount", "wrong", "late")],
    )


def loan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily loan rows without the customer. Some paid amounts are negative."""
    return _with_amounts(_loan_rows(spark, sf_dir))


def loan_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily loan rows with customer and start date, as the domain has them.

    Loans are hashed task by task, so the daily rows, several for each, are not sorted to meet them. Amounts are worked out
    after the join, where they need not be shuffled.
    """
    return _with_amounts(_loan_rows(spark, sf_dir).join(loans(spark, sf_dir).hint("shuffle_hash"), "loan_id"))


def attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dirty row per customer."""
    key = F.col("c_custkey")
    age = (key % 120).cast("string")
    return table(spark, sf_dir, "customer").select(
        key.alias("Customer_ID"),
        F.col("c_name").alias("Name"),
        F.when(key % 17 == 0, "abc")
        .when(key % 19 == 0, F.concat(age, F.lit(".0")))
        .when(key % 7 == 0, F.concat(age, F.lit("_")))
        .otherwise(age)
        .alias("Age"),
        F.when(key % 13 == 0, F.lit(None))
        .when(key % 11 == 0, "#F%$D@*&8")
        .otherwise(
            F.concat_ws(
                "-",
                F.lpad((key % 1000).cast("string"), 3, "0"),
                F.lpad((key % 100).cast("string"), 2, "0"),
                F.lpad((key % 10000).cast("string"), 4, "0"),
            )
        )
        .alias("SSN"),
        F.when(key % 5 == 0, " _______ ")
        .when(key % 9 == 0, "_")
        .otherwise(F.concat(F.lit(" "), "c_mktsegment"))
        .alias("Occupation"),
    )


def attribute_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.explode(F.sequence(F.lit(0), F.lit(SNAPSHOTS - 1)))
    first = (F.col("Customer_ID") % 900).cast("int")
    return (
        attributes(spark, sf_dir)
        .withColumn("step", step)
        .withColumn(
            "snapshot_date",
            F.date_add(F.lit("1995-01-01").cast("date"), first + F.col("step") * SNAPSHOT_STEP),
        )
        .withColumns({"year": F.year("snapshot_date"), "month": F.month("snapshot_date")})
        .drop("step")
    )


def financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One dirty snapshot per order, with days on which a customer has several."""
    key = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    annual, monthly = _decimal_text(cents), _decimal_text(_whole(cents, 12) + key % 1009 * 100)
    debt = _decimal_text(F.when(key % 211 == 0, -cents).otherwise(cents * (key % 7)))
    years, months = _whole(key % 400, 12).cast("string"), (key % 400 % 12).cast("string")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("Customer_ID"),
        F.when(key % 5 == 0, F.concat(F.lit("_"), annual, F.lit("_"))).otherwise(annual).alias("Annual_Income"),
        F.when(key % 23 == 0, "0")
        .when(key % 29 == 0, "")
        .otherwise(monthly)
        .alias("Monthly_Inhand_Salary"),
        (key % 9).cast("string").alias("Num_of_Loan"),
        debt.alias("Outstanding_Debt"),
        _decimal_text(_whole(cents, 100) + key % 773 * 40).alias("Total_EMI_per_month"),
        F.when(key % 31 == 0, "__10000__").otherwise(_decimal_text(_whole(cents, 150) + key % 557 * 30)).alias("Amount_invested_monthly"),
        _decimal_text(_whole(cents, 50) - key % 13 * 10000).alias("Monthly_Balance"),
        F.when(key % 6 == 0, "NM").when(key % 10 == 3, " _ ").otherwise(F.col("o_orderpriority")).alias("Credit_Mix"),
        F.when(key % 8 == 0, "NM").otherwise(F.col("o_orderstatus")).alias("Payment_of_Min_Amount"),
        F.when(key % 4 == 0, "_______").otherwise(F.concat(F.lit("plan "), (key % 3).cast("string"))).alias("Payment_Behaviour"),
        F.when(key % 37 == 0, F.lit(None))
        .when(key % 41 == 0, F.concat(years, F.lit(" Year and "), months, F.lit(" Month")))
        .otherwise(F.concat(years, F.lit(" Years and "), months, F.lit(" Months")))
        .alias("Credit_History_Age"),
        F.to_date("o_orderdate").alias("snapshot_date"),
        F.year("o_orderdate").alias("year"),
        F.month("o_orderdate").alias("month"),
    )


def clickstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, value = F.col("event_id"), F.col("value")
    features = [
        F.when(key % (i + 10) != 0, F.sqrt(value * (1 + key * i % 11))).alias(name)
        for i, name in enumerate(CLICK_FEATURES, start=1)
    ]
    return table(spark, sf_dir, "events").select(
        key.alias("event_id"),
        F.col("user_id").alias("Customer_ID"),
        F.date_sub(F.to_date("ts"), CLICK_SHIFT_DAYS).alias("snapshot_date"),
        *features,
    )


def calendar_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their date as text, in good and bad forms."""
    day, key = F.col("o_orderdate"), F.col("o_orderkey")
    form = key % 12
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(form == 0, F.date_format(day, "d/M/yyyy"))
        .when(form == 1, F.concat(F.lit(" "), F.date_format(day, "dd/MM/yyyy"), F.lit("\t")))
        .when(form == 2, F.concat(F.lit("31/02/"), F.date_format(day, "yyyy")))
        .when(form == 3, F.date_format(day, "dd/MM/yy"))
        .when(form == 4, F.date_format(day, "yyyy-MM-dd"))
        .when(form == 5, F.concat(F.date_format(day, "dd/MM/yyyy"), F.lit(" 00:00")))
        .when(form == 6, F.concat(F.lit("0"), F.date_format(day, "dd/MM/yyyy")))
        .when(form == 7, F.lit(None))
        .when(form == 8, F.lit("31/12/9999"))
        .otherwise(F.date_format(day, "dd/MM/yyyy"))
        .alias("snapshot_date"),
    )


def bronze(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four tables as they come out of bronze."""
    return {
        "attributes": attribute_snapshots(spark, sf_dir),
        "financials": financials(spark, sf_dir),
        "loan_daily": loan_daily(spark, sf_dir),
        "clickstream": clickstream(spark, sf_dir).drop("event_id"),
    }


def cleaned(spark: SparkSession, sf_dir: str) -> Cleaned:
    return clean_tables(bronze(spark, sf_dir))


