"""Queries over the benchmark tables, one or more per operator.

Each takes the session and the folder of the tables. Sums and ratios of doubles are rounded
here, not in the operators, so that another engine's summation order gives the same values.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace
from uuid import uuid4

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.config import Config
from riskmart.functions import parse_day_month_year
from riskmart.operators import (
    asof,
    dictionary,
    features,
    history,
    ingest,
    labels,
    metrics,
    model,
    quality,
    selection,
    splits,
)
from riskmart.plans import domain, modelling, stored_history
from riskmart.plans.bronze import ingest_rows, ingest_source, mirror_source, read_source
from riskmart.plans.gold import build_gold
from riskmart.plans.increment import update_gold, update_silver
from riskmart.plans.silver import TABLES
from riskmart.schemas import CLICK_FEATURES, FINANCIAL_NUMBERS, LOAN_AMOUNTS
from riskmart.sources import (
    digest,
    list_files,
    materialize,
    read_csv,
    read_partitions,
    remove,
    shared_dir,
    write_partitions,
    write_table,
)

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def stored_dir(spark: SparkSession, sf_dir: str) -> str:
    """A folder for what is derived from the tables of ``sf_dir`` as they are now."""
    tables = sorted({"customer", "orders", "lineitem", "events"})
    files = [list_files(spark, f"{sf_dir}/{t}.parquet") for t in tables]
    return f"{shared_dir(spark)}/{digest(sf_dir, files)[:12]}"


def stored(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table of this application's shared folder, built on first use."""
    return materialize(spark, build, f"{stored_dir(spark, sf_dir)}/{name}")


def stored_here(df: DataFrame, name: str) -> DataFrame:
    """The rows written to a new path and read back."""
    path = scratch(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.parquet(path)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for one round trip."""
    return f"{shared_dir(spark)}/{name}-{uuid4().hex}"


# Labels


def label_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loans with prediction date and window end."""
    return labels.label_windows(labels.loan_info(domain.loans(spark, sf_dir)))


def label_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_store(domain.loan_events(spark, sf_dir), loans=domain.loans(spark, sf_dir))


def label_store_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.label_store(domain.loan_daily(spark, sf_dir))


def loan_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.loan_info(domain.loan_daily(spark, sf_dir))


def default_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.default_events(label_window(spark, sf_dir), domain.loan_events(spark, sf_dir))


def label_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.label_distribution(label_store(spark, sf_dir))


def shared_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.shared_loans(label_window(spark, sf_dir))


# Bronze


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.calendar_texts(spark, sf_dir).withColumn(
        "snapshot_date", parse_day_month_year(F.col("snapshot_date"))
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.with_calendar(domain.calendar_texts(spark, sf_dir))


def bronze_valid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.valid_rows(calendar(spark, sf_dir))


def bronze_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.rejected_rows(calendar(spark, sf_dir))


def partition_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.partition_distribution(calendar(spark, sf_dir))


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to CSV, some names as missing-value tokens, and back with declared types."""
    key = F.col("c_custkey")
    name = (
        F.when(key % 10 == 0, "NA")
        .when(key % 10 == 1, "null")
        .when(key % 10 == 2, 'say "NM", twice')
        .when(key % 10 == 3, F.concat(F.lit("two\n"), "c_name"))
        .otherwise(F.concat(F.lit(" "), "c_name"))
    )
    path = scratch(spark, "customer-csv")
    customer = domain.table(spark, sf_dir, "customer").withColumn("c_name", name)
    customer.write.option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False
    ).csv(path)
    types = {"c_custkey": T.LongType(), "c_nationkey": T.IntegerType(), "c_acctbal": T.DoubleType()}
    schema = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in customer.columns])
    return read_csv(spark, path, schema, multi_line=True)


def csv_undeclared_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders to CSV and through the ingest, with only the date declared: the rest comes back as what its texts are."""
    path, bronze = scratch(spark, "orders-csv"), scratch(spark, "orders-bronze")
    orders = domain.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("customer"),
        "o_totalprice",
        "o_orderpriority",
        F.when(F.col("o_orderkey") % 5 == 0, "NA").otherwise(F.col("o_orderkey").cast("string")).alias("gaps"),
        F.when(F.col("o_orderkey") == 1, "one").otherwise(F.col("o_custkey").cast("string")).alias("mostly_numbers"),
        F.date_format("o_orderdate", "d/M/yyyy").alias("snapshot_date"),
    )
    orders.write.option("header", True).option("escape", '"').csv(path)
    ingest_source(spark, "orders", path, bronze)
    return read_source(spark, bronze, "orders").drop("year", "month")


def _order_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as texts with columns that no schema knows, some of them different from part to part."""
    key = F.col("o_orderkey")
    return domain.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("customer"),
        F.col("o_totalprice").alias("price"),
        F.when(F.col("o_totalprice") > 150000, "True").otherwise("False").alias("large"),
        F.col("o_orderpriority").alias("priority"),
        F.date_format("o_orderdate", "d/M/yyyy").alias("snapshot_date"),
        F.year("o_orderdate").alias("y"),
        (key % 7).alias("lot"),
    )


def _write_csv(df: DataFrame, path: str) -> str:
    df.coalesce(1).write.option("header", True).option("escape", '"').csv(path)
    return path


def csv_types_over_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in three batches by year: a column is empty in the first, whole in the second and decimal in the third; others come late."""
    bronze = scratch(spark, "orders-batches")
    orders = _order_texts(spark, sf_dir)
    shown = ["o_orderkey", "customer", "snapshot_date"]
    whole, half = F.col("lot"), (F.col("lot") / 2).cast("string")
    none = F.lit(None).cast("string")
    batches = [
        orders.filter("y <= 1994").select(*shown, none.alias("measure"), none.alias("priority"), "large"),
        orders.filter("y between 1995 and 1996").select(*shown, whole.alias("measure"), "priority", none.alias("large")),
        orders.filter("y > 1996").select(*shown, half.alias("measure"), none.alias("priority"), "large", F.col("price").alias("late")),
    ]
    for i, batch in enumerate(batches):
        ingest_source(spark, "orders", _write_csv(batch, scratch(spark, f"orders-batch-{i}")), bronze)
    return read_source(spark, bronze, "orders").drop("year", "month")


def bronze_mirrors_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in seven files; then one file changes, one goes and one is added: what bronze holds after the second ingest."""
    raw, bronze = scratch(spark, "orders-files"), scratch(spark, "orders-mirror")
    orders = _order_texts(spark, sf_dir).select("o_orderkey", "customer", "price", "priority", "snapshot_date", "lot")
    for lot in range(6):
        _write_csv(orders.filter(F.col("lot") == lot).drop("lot"), f"{raw}/{lot}")
    mirror_source(spark, "orders", f"{raw}/*/*.csv", bronze)
    remove(spark, f"{raw}/0")
    remove(spark, f"{raw}/1")
    corrected = orders.filter("lot = 1 and snapshot_date like '%/1995'").withColumn("price", -F.col("price"))
    _write_csv(corrected.drop("lot"), f"{raw}/1")
    _write_csv(orders.filter("lot = 6").drop("lot").withColumn("note", F.lit("late")), f"{raw}/6")
    mirror_source(spark, "orders", f"{raw}/*/*.csv", bronze)
    return read_source(spark, bronze, "orders")


def _dated_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    return domain.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_totalprice",
        day.alias("snapshot_date"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
    )


def bronze_partitioned_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "orders-by-month")
    write_partitions(_dated_orders(spark, sf_dir), path)
    return read_partitions(spark, path)


def bronze_partition_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, then a second batch that replaces June 1996 with corrected prices."""
    path = scratch(spark, "orders-two-batches")
    orders = _dated_orders(spark, sf_dir)
    write_partitions(orders, path)
    june = orders.filter((F.col("year") == 1996) & (F.col("month") == 6))
    write_partitions(june.withColumn("o_totalprice", -F.col("o_totalprice")), path)
    return read_partitions(spark, path)


def bronze_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back two months of the partitioned table."""
    path = scratch(spark, "orders-pruned")
    write_partitions(_dated_orders(spark, sf_dir), path)
    return read_partitions(spark, path, [(1996, 6), (1997, 1)])


def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "customer")
    write_table(domain.table(spark, sf_dir, "customer"), path)
    return spark.read.parquet(path)


# Silver


def clean_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.clean_attributes(domain.attributes(spark, sf_dir))


def flag_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.flag_attributes(clean_attributes(spark, sf_dir)).select(
        "Customer_ID", "Age", "SSN", "age_flag", "ssn_flag", quality.ISSUE
    )


def clean_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = quality.clean_financials(domain.financials(spark, sf_dir))
    return cleaned.withColumns({c: F.col(c).cast("double") for c in FINANCIAL_NUMBERS}).drop("year", "month")


def flag_financials(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = quality.clean_financials(domain.financials(spark, sf_dir))
    return quality.flag_financials(cleaned).select("Customer_ID", "snapshot_date", quality.ISSUE)


def flag_loans(spark: SparkSession, sf_dir: str) -> DataFrame:
    flagged = quality.flag_loans(domain.loan_events(spark, sf_dir))
    return rounded(flagged, 4, *LOAN_AMOUNTS)


def flagged_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.cleaned(spark, sf_dir).flagged


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "flagged", lambda: flagged_customers(spark, sf_dir))


def flag_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = metrics.flag_summary(domain.bronze(spark, sf_dir), _flagged(spark, sf_dir))
    return rounded(summary, 6, "flagged_percent")


def remove_flagged_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.remove_flagged(domain.loans(spark, sf_dir), _flagged(spark, sf_dir))


def remove_flagged_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.remove_flagged(domain.loan_daily(spark, sf_dir), _flagged(spark, sf_dir))
    return rounded(kept, 4, *LOAN_AMOUNTS)


def remove_flagged_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily loans without the flagged customers, of which only possible members meet the exact anti join."""
    flagged = _flagged(spark, sf_dir)
    kept = quality.remove_flagged_split(domain.loan_daily(spark, sf_dir), flagged, flagged.count())
    return rounded(kept, 4, *LOAN_AMOUNTS)


def remove_flagged_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.remove_flagged(clean_attributes(spark, sf_dir), _flagged(spark, sf_dir))


def remove_flagged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = quality.remove_flagged(domain.clickstream(spark, sf_dir), _flagged(spark, sf_dir))
    return rounded(kept, 6, *CLICK_FEATURES)


def removal_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.removal_counts(domain.bronze(spark, sf_dir), _flagged(spark, sf_dir))


# Gold


def loan_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = history.loan_history(domain.loan_events(spark, sf_dir), label_window(spark, sf_dir))
    return rounded(past, 4, *LOAN_AMOUNTS)


def shared_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label windows of loans of which some belong to two customers and some have no id."""
    loans = domain.loans(spark, sf_dir)
    key = F.col("loan_id")
    second = loans.filter(key % 7 == 0).withColumn("Customer_ID", F.col("Customer_ID") + 1)
    mixed = loans.unionByName(second).withColumn("loan_id", F.when(key % 11 != 0, key))
    return labels.label_windows(labels.loan_info(mixed))


def shared_loans_mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.shared_loans(shared_windows(spark, sf_dir).filter("loan_id is not null"))


def loan_history_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of shared loans: a row counts once for each customer of its loan."""
    past = history.loan_history(domain.loan_events(spark, sf_dir), shared_windows(spark, sf_dir))
    return rounded(past, 4, *LOAN_AMOUNTS)


def default_events_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.default_events(shared_windows(spark, sf_dir), domain.loan_events(spark, sf_dir))


LOAN_SUMS = ("hist_total_paid", "hist_total_due", "hist_total_overdue_amount")


def _loan_agg(spark: SparkSession, sf_dir: str, grain: str, history_end: str = "inclusive") -> DataFrame:
    totals = history.loan_agg(domain.loan_daily(spark, sf_dir), label_window(spark, sf_dir), grain, history_end)
    return rounded(rounded(totals, 4, *LOAN_SUMS), 8, "hist_Loan_Payment_Ratio")


def loan_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loan_agg(spark, sf_dir, "customer")


def loan_agg_loan_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loan_agg(spark, sf_dir, "loan")


def loan_agg_before_prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loan_agg(spark, sf_dir, "customer", "exclusive")


def clickstream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    past = history.clickstream_history(domain.clickstream(spark, sf_dir), label_window(spark, sf_dir))
    return past.select("event_id", "Customer_ID", "snapshot_date", history.WEIGHT)


CLICK_STATISTICS = tuple(f"{c}_{s}" for s in ("mean", "std") for c in CLICK_FEATURES)


def _clickstream_agg(spark: SparkSession, sf_dir: str, grain: str) -> DataFrame:
    statistics = history.clickstream_agg(domain.clickstream(spark, sf_dir), label_window(spark, sf_dir), grain)
    return rounded(statistics, 6, *CLICK_STATISTICS)


def clickstream_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clickstream_agg(spark, sf_dir, "customer")


def clickstream_agg_loan_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clickstream_agg(spark, sf_dir, "loan")


def loan_agg_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loan sums from day tables that two batches were added to, the second of them twice; the batches share most days."""
    path = scratch(spark, "loan-days")
    daily = domain.loan_daily(spark, sf_dir)
    odd = F.pmod(F.xxhash64("loan_amt", "due_amt"), F.lit(2)) == 1
    for batch, part in (("1", daily.filter(odd)), ("2", daily.filter(~odd)), ("2", daily.filter(~odd))):
        stored_history.add_loan_days(spark, path, part, batch)
    totals = history.loan_agg(stored_history.read_days(spark, path), label_window(spark, sf_dir))
    return rounded(rounded(totals, 4, *LOAN_SUMS), 8, "hist_Loan_Payment_Ratio")


def clickstream_agg_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Click statistics from stored moments of days whose clicks came in two batches."""
    path = scratch(spark, "click-days")
    clicks = domain.clickstream(spark, sf_dir)
    for batch in (0, 1):
        stored_history.add_click_days(spark, path, clicks.filter(F.col("event_id") % 2 == batch), str(batch))
    statistics = history.clickstream_agg_of_days(stored_history.read_days(spark, path), label_window(spark, sf_dir))
    return rounded(statistics, 6, *CLICK_STATISTICS)


def order_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domain.table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("Customer_ID"),
        F.to_date("o_orderdate").alias("snapshot_date"),
        "o_totalprice",
        "o_orderpriority",
    )


def asof_customer_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.asof_latest(order_snapshots(spark, sf_dir), label_window(spark, sf_dir))


def asof_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a month-partitioned table, from the newest months back."""

    def build() -> DataFrame:
        snapshots = order_snapshots(spark, sf_dir)
        return snapshots.withColumns({"year": F.year("snapshot_date"), "month": F.month("snapshot_date")})

    path = scratch(spark, "snapshots-by-month")
    write_partitions(build(), path)
    months = [(r.year, r.month) for r in spark.read.parquet(path).select("year", "month").distinct().collect()]
    read = lambda some: read_partitions(spark, path, some).drop("year", "month")
    return asof.asof_newest_first(read, months, label_window(spark, sf_dir))


def asof_max_rejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.asof_max_rejoin(order_snapshots(spark, sf_dir), label_window(spark, sf_dir))


def asof_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.asof_running_max(order_snapshots(spark, sf_dir), label_window(spark, sf_dir))


def asof_loan_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.asof_latest(order_snapshots(spark, sf_dir), label_window(spark, sf_dir), "loan")


def credit_history_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    years, months = F.floor(size / 12).cast("string"), (size % 12).cast("string")
    text = (
        F.when(key % 10 == 0, F.lit(None))
        .when(key % 10 == 1, F.concat(years, F.lit(" Year and "), months, F.lit(" Months")))
        .when(key % 10 == 2, F.concat(years, F.lit(" Years")))
        .otherwise(F.concat(years, F.lit(" Years and "), months, F.lit(" Months")))
    )
    return domain.table(spark, sf_dir, "part").select(
        "p_partkey",
        features.credit_history_months(text).alias("months_plural_only"),
        features.credit_history_months(text, plural_only=False).alias("months_any_form"),
    )


RATIOS = ("DTI", "Savings_Ratio", "Debt_to_Annual_Income")


def financial_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = quality.clean_financials(domain.financials(spark, sf_dir))
    engineered = features.financial_features(cleaned).select(
        "Customer_ID", "snapshot_date", "Credit_History_Months", "Monthly_Surplus", *RATIOS
    )
    return rounded(rounded(engineered, 8, *RATIOS), 4, "Monthly_Surplus")


def _silver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A silver table as a run has it: stored, flagged customers removed."""

    def build() -> DataFrame:
        tables = domain.cleaned(spark, sf_dir).tables
        return quality.remove_flagged(tables[name], _flagged(spark, sf_dir))

    return stored(spark, sf_dir, f"silver-{name}", build)


def _silver_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        return labels.label_store(_silver_table(spark, sf_dir, "loan_daily"))

    return stored(spark, sf_dir, "label_store", build)


def gold(spark: SparkSession, sf_dir: str, grain: str = "customer") -> DataFrame:
    silver = {name: _silver_table(spark, sf_dir, name) for name in TABLES}
    return features.gold_features(_silver_labels(spark, sf_dir), **silver, grain=grain)


def _rounded_gold(df: DataFrame) -> DataFrame:
    floats = rounded(df, 4, *FINANCIAL_NUMBERS, "Monthly_Surplus", *LOAN_SUMS)
    return rounded(rounded(floats, 8, *RATIOS, "hist_Loan_Payment_Ratio"), 6, *CLICK_STATISTICS)


def gold_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_gold(gold(spark, sf_dir))


def gold_features_loan_grain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_gold(gold(spark, sf_dir, "loan"))


# Model


def _stored_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "gold", lambda: gold(spark, sf_dir))


def feature_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _stored_gold(spark, sf_dir)
    return model.feature_presence(df, *model.feature_columns(df))


def prediction_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.prediction_months(label_window(spark, sf_dir))


def _sides(train: DataFrame, test: DataFrame) -> DataFrame:
    train, test = (df.select("loan_id", "Customer_ID", "prediction_date") for df in (train, test))
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


def oot_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(*splits.oot_split(label_window(spark, sf_dir)))


def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sides(*splits.hash_split(label_window(spark, sf_dir), "Customer_ID", "loan_id"))


def _stages(df: DataFrame, categorical: Sequence[str], numeric: Sequence[str], n: int) -> DataFrame:
    """``df`` after the first ``n`` stages of the library's pipeline."""
    for stage in model.create_pipeline(categorical, numeric).getStages()[:n]:
        df = (stage.fit(df) if hasattr(stage, "fit") else stage).transform(df)
    return df


def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill a column of three levels, whose median is clear within the imputer's error."""
    last = F.col("c_custkey") % 10
    level = F.when(last.isin(1, 2), 1.0).when(last.isin(3, 4, 5, 6), 2.5).when(last.isin(7, 8, 9), 4.0)
    customers = domain.table(spark, sf_dir, "customer").select("c_custkey", level.alias("level"), level.alias("filled"))
    return _stages(customers, [], ["filled"], 1)


CATEGORIES = ("priority", "status")


def _categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return domain.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(key % 6 != 0, F.col("o_orderpriority")).alias("priority"),
        F.when(key % 7 != 0, F.col("o_orderstatus")).alias("status"),
        "o_totalprice",
    )


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stages(_categories(spark, sf_dir), CATEGORIES, ["o_totalprice"], 1)


def _encoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stages(_categories(spark, sf_dir), CATEGORIES, ["o_totalprice"], 2)


def string_index_distributed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indices by a joined dictionary; a third column has another category in each row, as numerals of equal length."""
    rows = _categories(spark, sf_dir).withColumn("own", F.format_string("%012d", F.col("o_orderkey")))
    columns = [*CATEGORIES, "own"]
    found = dictionary.category_dictionary(rows, columns)
    return dictionary.indexed(rows, stored_here(found, "dictionary"), columns).drop("o_totalprice")


def sparse_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero slots of vectors with a slot for every order."""
    rows = _categories(spark, sf_dir).withColumn("own", F.format_string("%012d", F.col("o_orderkey")))
    columns = [*CATEGORIES, "own"]
    found = stored_here(dictionary.category_dictionary(rows, columns), "dictionary")
    sizes = dictionary.dictionary_sizes(found, columns)
    return dictionary.sparse_slots(dictionary.indexed(rows, found, columns), ["o_orderkey"], sizes, ["o_totalprice"])


def exact_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians and ninth deciles of columns with many values, some missing, one with few."""
    prices = domain.table(spark, sf_dir, "orders").select(
        "o_totalprice",
        F.when(F.col("o_orderkey") % 3 != 0, -F.col("o_totalprice") * F.col("o_totalprice")).alias("squared"),
        F.col("o_orderkey").alias("key"),
        (F.col("o_orderkey") % 4).cast("double").alias("level"),
    )
    rows = []
    for q in (0.5, 0.9):
        rows += [(c, q, v) for c, v in selection.exact_quantiles(prices, prices.columns, q).items()]
    return spark.createDataFrame(rows, "feature string, q double, value double")


def auc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of a score with about as many values as rows, and ties."""
    scored = domain.table(spark, sf_dir, "lineitem").select(
        (F.floor("l_extendedprice") + F.when(F.col("l_returnflag") == "R", 500).otherwise(0)).alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )
    return rounded(model.exact_area_of_scores(scored), 9, "area_under_roc")


def string_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir).select("o_orderkey", *CATEGORIES, *[f"{c}_idx" for c in CATEGORIES])


def one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of each one-hot vector and the slot that is set, -1 if none is."""
    columns = []
    for c in CATEGORIES:
        slots = vector_to_array(f"{c}_ohe")
        columns.append(F.size(slots).alias(f"{c}_width"))
        columns.append((F.array_position(slots, 1.0) - 1).cast("int").alias(f"{c}_slot"))
    return _encoded(spark, sf_dir).select("o_orderkey", *columns)


def assemble_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assembled vectors: their width, and one row per slot that is not zero."""
    vectors = _stages(_categories(spark, sf_dir), CATEGORIES, ["o_totalprice"], 4)
    entries = F.col("entries")
    return (
        vectors.select("o_orderkey", F.size(vector_to_array("features")).alias("width"), F.filter(F.transform(vector_to_array("features"), lambda v, i: F.struct(i.alias("slot"), v.alias("value"))), lambda e: e["value"] != 0).alias("entries"))
        .select("o_orderkey", "width", F.explode(entries).alias("entry"))
        .select("o_orderkey", "width", "entry.slot", "entry.value")
    )


def _model_data(
    spark: SparkSession, sf_dir: str, model_type: str
) -> tuple[Pipeline, DataFrame, DataFrame]:
    df = _stored_gold(spark, sf_dir)
    train, test = modelling.split(df)
    columns = model.trainable_columns(train, *model.feature_columns(df))
    return model.create_pipeline(*columns, model_type), train, test


def _saved_model(
    spark: SparkSession, sf_dir: str, model_type: str, refresh: bool = False
) -> tuple[PipelineModel, DataFrame, DataFrame]:
    pipeline, train, test = _model_data(spark, sf_dir, model_type)
    path = f"{stored_dir(spark, sf_dir)}/models/{model_type}"
    return model.fit_or_load(spark, pipeline, train, path, refresh), train, test


def gold_scores(spark: SparkSession, sf_dir: str, model_type: str) -> DataFrame:
    """Fit on the gold table, save and score."""
    fitted, _, test = _saved_model(spark, sf_dir, model_type, refresh=True)
    return model.score(fitted, test).select("Customer_ID", "loan_id", "label", "default_probability", "prediction")


def _rule_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a label that one column of few values decides, beside columns that say nothing."""
    level = F.col("o_orderkey") % 4
    return domain.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        level.cast("double").alias("level"),
        F.lit(1.0).alias("flat"),
        F.lit("same").alias("kind"),
        (level >= 2).cast("int").alias("label"),
    )


def _rule_model(spark: SparkSession, sf_dir: str, model_type: str) -> tuple[PipelineModel, DataFrame]:
    rows = stored(spark, sf_dir, "rule_rows", lambda: _rule_rows(spark, sf_dir))
    columns = model.trainable_columns(rows, *model.feature_columns(rows, exclude=["o_orderkey"]))
    pipeline = model.create_pipeline(*columns, model_type)
    return model.fit_or_load(spark, pipeline, rows, f"{stored_dir(spark, sf_dir)}/rule-{model_type}"), rows


def _rule_scores(spark: SparkSession, sf_dir: str, model_type: str) -> DataFrame:
    fitted, rows = _rule_model(spark, sf_dir, model_type)
    return model.score(fitted, rows).select("o_orderkey", "label", "prediction")


def lr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_scores(spark, sf_dir, "logistic_regression")


def rf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rule_scores(spark, sf_dir, "random_forest")


def model_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas of both models on the rule, and of a score with few values that does not separate the classes."""
    areas = []
    for model_type in model.MODELS:
        fitted, rows = _rule_model(spark, sf_dir, model_type)
        areas.append((model_type, model.area_under_roc(fitted, rows)))
    key = F.col("o_orderkey")
    scored = domain.table(spark, sf_dir, "orders").select(
        (key * 7 % 10 + F.when(key % 3 == 0, 2).otherwise(0)).cast("double").alias("rawPrediction"),
        (key % 3 == 0).cast("int").alias("label"),
    )
    areas.append(("derived_score", model.area_of_scores(scored)))
    return rounded(spark.createDataFrame(areas, "model string, area_under_roc double"), 6, "area_under_roc")


def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted, rows = _rule_model(spark, sf_dir, "random_forest")
    return rounded(model.feature_importance(spark, fitted, rows), 6, "importance")


def gold_rebuilt_on_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and features built twice at one place, the second time by loan and three months ahead: the second result."""
    silver = {name: _silver_table(spark, sf_dir, name) for name in TABLES}
    config = Config.under(scratch(spark, "rebuilt"))
    for name, df in silver.items():
        materialize(spark, lambda df=df: df, f"{config.silver_path}/{name}", key="silver")
    build_gold(spark, config)
    changed = replace(config, grain="loan", prediction_months=3)
    rebuilt = build_gold(spark, changed)  # ties of financial snapshots repeat a loan
    return rebuilt.select("Customer_ID", "loan_id", "prediction_date", "label", "Age", "snapshot_date").distinct()


def rebuilt_after_new_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold brought up to date after a second batch: the months of 2001, and June 1997 with the amounts put right."""
    config = Config.under(scratch(spark, "increment"))
    day = F.col("snapshot_date")
    june = (F.year(day) == 1997) & (F.month(day) == 6)
    last = day >= F.lit("2001-01-01").cast("date")
    for name, df in domain.bronze(spark, sf_dir).items():
        first = df.filter(~last)
        if name == "loan_daily":  # wrong amounts flag other customers
            first = first.withColumn("paid_amt", F.when(june & (F.col("loan_id") % 97 == 0), F.lit(-1.0)).otherwise(F.col("paid_amt")))
        ingest_rows(spark, name, first, config.bronze_path)
    update_silver(spark, config.bronze_path, config.silver_path)
    update_gold(spark, config)
    for name, df in domain.bronze(spark, sf_dir).items():
        ingest_rows(spark, name, df.filter(last | june), config.bronze_path)
    update_silver(spark, config.bronze_path, config.silver_path)
    update_gold(spark, config)
    return _rounded_gold(spark.read.parquet(config.gold_path))


def model_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compare the test rows' scores by a model just fitted and by the same model loaded."""
    pipeline, train, test = _model_data(spark, sf_dir, "logistic_regression")
    path = scratch(spark, "model")
    fitted = model.score(model.fit_or_load(spark, pipeline, train, path), test)
    loaded = model.score(model.fit_or_load(spark, pipeline, train, path), test)
    key = ["Customer_ID", "loan_id", "default_probability", "prediction"]
    sides = fitted.select(*key, F.lit(1).alias("side")).unionByName(loaded.select(*key, F.lit(2).alias("side")))
    return (
        sides.groupBy(*key)
        .agg(
            F.count(F.when(F.col("side") == 1, 1)).alias("fitted"),
            F.count(F.when(F.col("side") == 2, 1)).alias("loaded"),
        )
        .agg(
            F.sum("fitted").alias("n_scored"),
            F.count(F.when(F.col("fitted") != F.col("loaded"), 1)).alias("n_different"),
        )
    )


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        label_store,
        label_store_domain,
        loan_info,
        label_window,
        default_events,
        label_distribution,
        shared_loans,
        shared_loans_mapped,
        default_events_shared,
        parse_dates,
        bronze_valid_rows,
        bronze_rejects,
        partition_distribution,
        csv_roundtrip,
        csv_undeclared_columns,
        csv_types_over_batches,
        bronze_mirrors_files,
        bronze_partitioned_roundtrip,
        bronze_partition_overwrite,
        bronze_months,
        parquet_roundtrip,
        clean_attributes,
        flag_attributes,
        clean_financials,
        flag_financials,
        flag_loans,
        flagged_customers,
        flag_summary,
        remove_flagged_orders,
        remove_flagged_lineitem,
        remove_flagged_split,
        remove_flagged_customer,
        remove_flagged_events,
        removal_counts,
        loan_history,
        loan_history_shared,
        loan_agg,
        loan_agg_loan_grain,
        loan_agg_before_prediction,
        clickstream_history,
        clickstream_agg,
        clickstream_agg_loan_grain,
        loan_agg_stored,
        clickstream_agg_stored,
        asof_customer_grain,
        asof_newest_first,
        asof_max_rejoin,
        asof_running_max,
        asof_loan_grain,
        credit_history_months,
        financial_ratios,
        gold_features,
        gold_features_loan_grain,
        gold_rebuilt_on_change,
        rebuilt_after_new_months,
        feature_columns,
        prediction_months,
        oot_split,
        hash_split,
        impute_median,
        string_index,
        string_index_distributed,
        sparse_features,
        exact_medians,
        auc_exact,
        one_hot,
        assemble_features,
        lr_scores,
        rf_scores,
        model_auc,
        feature_importance,
        model_save_load,
    )
}
