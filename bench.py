"""Time the headline queries; prints one JSON line.

Each query is run once to warm up and then three times; its median counts. Results go to a
sink that discards them. The silver tables, label store and feature matrix that later stages
start from are stored first, as in a run, and timed once and cold as ``stored_*``. ``hot_*`` have a third of the rows on
one customer or loan with some sixty label rows. ``paired_*`` are the same results as joins of rows with label rows.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from riskmart.config import RECOMMENDED_CONF  # noqa: E402
from riskmart.operators import history  # noqa: E402
from riskmart.plans import catalog  # noqa: E402
from riskmart.plans.bronze import ingest_source  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

# The same results written as joins of rows with label rows, ranks and repeated scans.
PAIRED = {
    "paired_clickstream_agg": """
        select c.Customer_ID, {statistics} from clicks c join spine s on c.Customer_ID = s.Customer_ID
        where c.snapshot_date <= s.prediction_date group by c.Customer_ID""",
    "paired_loan_agg": """
        select d.Customer_ID, sum(paid_amt), sum(due_amt), sum(overdue_amt)
        from loan_daily d join spine s on d.loan_id = s.loan_id
        where d.snapshot_date <= s.prediction_date group by d.Customer_ID""",
    "paired_asof": """
        select x.* from snapshots x join (
            select x.Customer_ID, max(x.snapshot_date) latest from snapshots x
            join spine s on x.Customer_ID = s.Customer_ID
            where x.snapshot_date <= s.prediction_date group by x.Customer_ID) l
        on x.Customer_ID = l.Customer_ID and x.snapshot_date = l.latest""",
}

HOT_LABELS = 60
HOT = {
    "paired_hot_clickstream_agg": PAIRED["paired_clickstream_agg"].replace("clicks c", "hot_clicks c").replace("spine s", "hot_customer s"),
    "paired_hot_loan_agg": PAIRED["paired_loan_agg"].replace("loan_daily d", "hot_loan_daily d").replace("spine s", "hot_loan s"),
}

STORED = ("stored_flagged", "stored_silver", "stored_labels", "stored_gold", "ingest")
HEADLINE = (
    "label_store",
    "flagged_customers",
    "remove_flagged_lineitem",
    "loan_agg",
    "clickstream_agg",
    "clickstream_agg_loan_grain",
    "asof_customer_grain",
    "asof_max_rejoin",
    "asof_running_max",
    "asof_loan_grain",
    "gold_features",
    "gold_features_loan_grain",
)
#: Timed beside the headline: forms for sets, categories and scores of any number.
EXTRA = ("remove_flagged_split", "string_index_distributed", "auc_exact")
MODELS = {"lr_scores": "logistic_regression", "rf_scores": "random_forest"}


def paired_queries(spark: SparkSession) -> dict:
    catalog.domain.clickstream(spark, SF_DIR).createOrReplaceTempView("clicks")
    catalog.domain.loan_daily(spark, SF_DIR).createOrReplaceTempView("loan_daily")
    catalog.order_snapshots(spark, SF_DIR).createOrReplaceTempView("snapshots")
    catalog.label_window(spark, SF_DIR).createOrReplaceTempView("spine")
    parts = [f"avg({c}) {c}_mean, stddev({c}) {c}_std" for c in catalog.CLICK_FEATURES]
    return {name: lambda q=q: spark.sql(q.format(statistics=", ".join(parts))) for name, q in PAIRED.items()}


def hot_queries(spark: SparkSession) -> dict:
    """A third of the clicks on one customer with many loans; a third of the payments on one loan of many customers."""
    key, spine = F.col("event_id"), catalog.label_window(spark, SF_DIR)
    clicks = catalog.domain.clickstream(spark, SF_DIR)
    clicks = clicks.withColumn("Customer_ID", F.when(key % 3 == 0, F.lit(-1)).otherwise(F.col("Customer_ID")))
    many = spine.count() // HOT_LABELS
    mine = F.pmod(F.xxhash64("loan_id"), F.lit(many)) == 0
    of_customer = spine.withColumn("Customer_ID", F.when(mine, F.lit(-1)).otherwise(F.col("Customer_ID")))
    of_loan = spine.withColumn("loan_id", F.when(mine, F.lit(-1)).otherwise(F.col("loan_id")))
    daily = catalog.domain.loan_daily(spark, SF_DIR)
    third = F.pmod(F.xxhash64("loan_id", "snapshot_date", "due_amt"), F.lit(3)) == 0
    daily = daily.withColumn("loan_id", F.when(third, F.lit(-1)).otherwise(F.col("loan_id")))
    views = {"hot_clicks": clicks, "hot_customer": of_customer, "hot_loan": of_loan, "hot_loan_daily": daily}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    parts = [f"avg({c}) {c}_mean, stddev({c}) {c}_std" for c in catalog.CLICK_FEATURES]
    return {
        "hot_clickstream_agg": lambda: history.clickstream_agg(clicks, of_customer),
        "hot_loan_agg": lambda: history.loan_agg(daily, of_loan),
        **{name: lambda q=q: spark.sql(q.format(statistics=", ".join(parts))) for name, q in HOT.items()},
    }


def ingest(spark: SparkSession, csv: str) -> None:
    """CSV to months and rejects."""
    ingest_source(spark, "orders", csv, catalog.scratch(spark, "bench-bronze"))


def seconds(build) -> float:
    start = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    builder = SparkSession.builder.master(f"local[{CPUS}]").appName("riskmart-bench")
    settings = RECOMMENDED_CONF | {
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.sql.shuffle.partitions": CPUS,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    times: dict[str, float] = {}
    csv = catalog.scratch(spark, "bench-csv")
    orders = catalog.domain.table(spark, SF_DIR, "orders")
    dated = orders.withColumn("snapshot_date", F.date_format("o_orderdate", "d/M/yyyy"))
    dated.write.option("header", True).option("escape", '"').csv(csv)
    for name, build in {
        "ingest": lambda: ingest(spark, csv),
        "stored_flagged": lambda: catalog._flagged(spark, SF_DIR),
        "stored_silver": lambda: [catalog._silver_table(spark, SF_DIR, n) for n in catalog.TABLES],
        "stored_labels": lambda: catalog._silver_labels(spark, SF_DIR),
        "stored_gold": lambda: catalog._stored_gold(spark, SF_DIR),
    }.items():
        start = time.perf_counter()
        build()
        times[name] = time.perf_counter() - start

    builders = {n: lambda n=n: catalog.QUERIES[n](spark, SF_DIR) for n in (*HEADLINE, *EXTRA)}
    only = set(filter(None, os.environ.get("BENCH_ONLY", "").split(",")))
    for name, build in {**builders, **paired_queries(spark), **hot_queries(spark)}.items():
        if only and name not in only:
            continue
        seconds(build)
        times[name] = statistics.median(seconds(build) for _ in range(RUNS))
    for name, model_type in MODELS.items():
        if not only or name in only:
            times[name] = seconds(lambda model_type=model_type: catalog.gold_scores(spark, SF_DIR, model_type))

    headline = [times[n] for n in (*STORED, *HEADLINE, *MODELS) if n in times]
    report = {
        "metric": "sum of median headline query times",
        "value": round(sum(headline), 3),
        "unit": "sec",
        "queries": {name: round(value, 3) for name, value in times.items()},
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(report))
    spark.stop()


if __name__ == "__main__":
    main()
