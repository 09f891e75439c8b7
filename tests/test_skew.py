"""Plans: hot keys are split, and nothing pairs whole tables or leaves the JVM."""

import pytest
from pyspark.sql import functions as F

from riskmart.operators import asof, features, history, labels, quality
from riskmart.plans import catalog, domain

SMALL = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
    "spark.sql.shuffle.partitions": "8",
}


@pytest.fixture
def tiny_thresholds(spark):
    """Skew handling as at scale, on small data."""
    before = {key: spark.conf.get(key, None) for key in SMALL}
    for key, value in SMALL.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.fixture
def hot(spark):
    """A third of all rows belongs to one loan and one customer."""
    key, start = F.col("id"), F.lit("2023-01-15").cast("date")
    is_hot = key % 3 == 0
    daily = spark.range(0, 120_000, 1, 8).select(
        F.when(is_hot, 0).otherwise(key % 5000).alias("loan_id"),
        F.when(is_hot, 0).otherwise(key % 997).alias("Customer_ID"),
        start.alias("loan_start_date"),
        F.date_add(start, (key % 300).cast("int")).alias("snapshot_date"),
        *[(F.rand(seed) - 0.01).alias(c) for seed, c in enumerate(("paid_amt", "due_amt", "overdue_amt"))],
    )
    return daily


def test_history_join_splits_a_hot_loan(spark, tiny_thresholds, hot):
    store = labels.label_windows(labels.loan_info(hot))
    assert "skew=true" in final_plan(history.loan_history(hot, store))
    assert "skew=true" in final_plan(history.loan_agg(hot, store))


def test_history_join_splits_a_hot_customer(spark, tiny_thresholds, hot):
    store = labels.label_windows(labels.loan_info(hot))
    assert "skew=true" in final_plan(history.clickstream_history(hot, store))


def test_removal_splits_a_hot_customer(spark, tiny_thresholds, hot):
    flagged = hot.filter(F.col("Customer_ID") > 900).select("Customer_ID").distinct()
    assert "skew=true" in final_plan(quality.remove_flagged(hot, flagged))


def test_gold_join_splits_a_hot_customer(spark, tiny_thresholds, hot):
    store = hot.select(
        F.when(F.rand(9) < 0.4, 0).otherwise(F.col("Customer_ID")).alias("Customer_ID"),
        F.monotonically_increasing_id().alias("loan_id"),
        F.lit("2023-06-01").cast("date").alias("prediction_date"),
        F.lit(0).alias("label"),
    )
    dated = hot.select("Customer_ID", "snapshot_date").dropDuplicates(["Customer_ID"])
    attributes = dated.withColumns({"Age": F.lit(30), "year": F.lit(2023), "month": F.lit(1)})
    financials = dated.withColumns(
        {c: F.lit(1.0).cast("float") for c in quality.FINANCIAL_NUMBERS} | {"Credit_History_Age": F.lit("1 Years")}
    )
    clicks = dated.withColumns({c: F.lit(1.0) for c in history.CLICK_FEATURES})
    gold = features.gold_features(store, attributes, financials, hot, clicks)
    plan = final_plan(gold.select("Customer_ID", "loan_id", "Age", "DTI", "fe_1_mean", "hist_total_due"))
    assert "SortMergeJoin(skew=true) [Customer_ID" in plan


def test_asof_finds_dates_on_distinct_days_only(spark, tiny_thresholds, hot):
    store = labels.label_windows(labels.loan_info(hot))
    plan = final_plan(asof.asof_latest(hot, store))
    assert "Window" not in plan
    assert "LeftSemi" in plan


def test_label_join_of_a_hot_shared_loan_is_split(spark, tiny_thresholds):
    key, start = F.col("id"), F.lit("2023-01-15").cast("date")
    shared = spark.range(0, 60_000, 1, 8).select(
        F.when(key % 3 == 0, 0).otherwise(key).alias("loan_id"),
        key.alias("Customer_ID"),
        start.alias("loan_start_date"),
        F.date_add(start, (key % 300).cast("int")).alias("snapshot_date"),
        F.lit(1.0).alias("overdue_amt"),
    )
    assert "skew=true" in final_plan(labels.label_store(shared))


RELATIONAL = (
    "label_store",
    "flagged_customers",
    "removal_counts",
    "loan_agg",
    "clickstream_history",
    "clickstream_agg",
    "clickstream_agg_loan_grain",
    "asof_customer_grain",
    "asof_loan_grain",
    "financial_ratios",
    "oot_split",
    "parse_dates",
)


@pytest.mark.parametrize("name", RELATIONAL)
def test_plans_have_no_pairing_and_no_python(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "MapInPandas", "FlatMapGroups"):
        assert node not in plan, node


def test_scans_are_pruned(spark):
    plan = catalog.QUERIES["label_store"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_tax" not in plan and "o_totalprice" not in plan
    assert "PushedFilters: [IsNotNull(l_shipdate), IsNotNull(l_orderkey)]" in plan


def test_spans_meet_overdue_days_straight_from_a_shuffle(spark, tiny_thresholds):
    """The tasks of their join hold none of the tables that made the spans."""
    plan = catalog.label_store_domain(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    semi = next(i for i, line in enumerate(lines) if "LeftSemi" in line)
    place = lines[semi + 1].index(":- ")
    spans = next(i for i in range(semi, len(lines)) if lines[i][place:].startswith("+- "))
    assert "Sort" in lines[spans] and "Exchange hashpartitioning" in lines[spans + 1]


def test_daily_loans_are_not_sorted_to_meet_their_loans(spark, tiny_thresholds):
    plan = final_plan(domain.loan_daily(spark, "/root/testdata/sf0.001"))
    assert "ShuffledHashJoin" in plan and "Sort" not in plan.replace("SortMerge", "")


def test_derived_financial_columns_are_worked_out_after_all_joins(spark):
    silver = domain.bronze(spark, "/root/testdata/sf0.001")
    silver["financials"] = quality.clean_financials(silver["financials"])
    gold = features.gold_features(labels.label_store(silver["loan_daily"]), **silver, grain="loan")
    above_joins = gold._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]
    assert "AS DTI#" in above_joins and "AS Credit_History_Months#" in above_joins


def test_sums_by_loan_split_a_hot_loan_and_move_its_rows_once(spark, tiny_thresholds, hot):
    store = labels.label_windows(labels.loan_info(hot)).select("loan_id", "Customer_ID", "prediction_date")
    plan = final_plan(history.loan_agg(hot, store, "loan"))
    assert "skew=true" in plan
    assert not any("Aggregate(" in line and "snapshot_date" in line for line in plan.splitlines())
