"""As-of selection: the latest snapshot on or before the prediction date, ties kept.

The date to pick is found on distinct (customer, day) pairs, and the wide rows are then
fetched by an equality join on both. Ranking the rows themselves in a window would hold
all snapshots of a customer in one task; the pairs never exceed the calendar days.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from uuid import uuid4

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskmart.operators.history import CUSTOMER, check_grain, history_cut
from riskmart.operators.skew import splittable
from riskmart.sources.ledger import Month
from riskmart.sources.tables import shared_dir, write_table


def _snapshot_days(snapshots: DataFrame) -> DataFrame:
    return (
        snapshots.filter(F.col(CUSTOMER).isNotNull() & F.col("snapshot_date").isNotNull())
        .select(CUSTOMER, "snapshot_date")
        .distinct()
    )


def _last_cuts(labels: DataFrame, history_end: str) -> DataFrame:
    """The latest cut of each customer: some prediction is on or after a snapshot exactly
    if the latest one is."""
    return (
        labels.filter(F.col(CUSTOMER).isNotNull())
        .groupBy(CUSTOMER)
        .agg(F.max(history_cut(history_end)).alias("cut"))
    )


def latest_days(days: DataFrame, cuts: DataFrame) -> DataFrame:
    """For each (customer, cut): the last of the customer's days that is not after it.

    A running maximum over days and cuts together, so neither side is paired with the other.
    """
    marked = days.select(CUSTOMER, F.col("snapshot_date").alias("day"), "snapshot_date").unionByName(
        cuts.select(CUSTOMER, F.col("cut").alias("day"), "cut"), allowMissingColumns=True
    )
    so_far = (
        Window.partitionBy(CUSTOMER)
        .orderBy("day")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        marked.withColumn("snapshot_date", F.max("snapshot_date").over(so_far))
        .filter(F.col("cut").isNotNull() & F.col("snapshot_date").isNotNull())
        .select(CUSTOMER, "cut", "snapshot_date")
    )


def latest_day_by_max(days: DataFrame, last_cuts: DataFrame) -> DataFrame:
    """As ``latest_days`` for a single cut per customer, by a join and a maximum."""
    return (
        days.join(last_cuts, CUSTOMER)
        .filter(F.col("snapshot_date") <= F.col("cut"))
        .groupBy(CUSTOMER)
        .agg(F.max("snapshot_date").alias("snapshot_date"))
    )


def asof_latest(
    snapshots: DataFrame, labels: DataFrame, grain: str = "customer", history_end: str = "inclusive"
) -> DataFrame:
    """Snapshots in force at the prediction date.

    ``customer``: one day per customer, as of the latest of its prediction dates, which
    lets earlier loans see later snapshots. ``loan``: one day per (customer, prediction
    date); the result has the extra column ``prediction_date``.
    """
    check_grain(grain)
    if grain == "customer":
        return asof_max_rejoin(snapshots, labels, history_end)
    shift = 0 if history_end == "inclusive" else 1
    cuts = (
        labels.filter(F.col(CUSTOMER).isNotNull())
        .select(CUSTOMER, history_cut(history_end).alias("cut"))
        .distinct()
    )
    picks = latest_days(_snapshot_days(snapshots), cuts).select(
        CUSTOMER, "snapshot_date", F.date_add("cut", shift).alias("prediction_date")
    )
    return snapshots.join(picks, [CUSTOMER, "snapshot_date"]).select(*snapshots.columns, "prediction_date")


def asof_running_max(snapshots: DataFrame, labels: DataFrame, history_end: str = "inclusive") -> DataFrame:
    """Customer grain by the running maximum."""
    picks = latest_days(_snapshot_days(snapshots), _last_cuts(labels, history_end))
    return snapshots.join(picks, [CUSTOMER, "snapshot_date"], "left_semi").select(*snapshots.columns)


def asof_max_rejoin(snapshots: DataFrame, labels: DataFrame, history_end: str = "inclusive") -> DataFrame:
    """Customer grain by maximum and rejoin."""
    picks = latest_day_by_max(_snapshot_days(snapshots), _last_cuts(labels, history_end))
    return snapshots.join(picks, [CUSTOMER, "snapshot_date"], "left_semi").select(*snapshots.columns)


def asof_newest_first(
    read: Callable[[list[Month]], DataFrame],
    months: Iterable[Month],
    labels: DataFrame,
    history_end: str = "inclusive",
) -> DataFrame | None:
    """Customer grain over a month-partitioned table, reading no month older than some customer needs.

    ``read`` gives the rows of some months. Months after the last cut are skipped. From there one month is read, then the two before it, then four and
    so on; customers with a snapshot are answered by it and don't meet older months. Answers and open customers are written tables, so each step's plan
    is short. None if there is no snapshot at all.
    """
    spark = labels.sparkSession
    folder = f"{shared_dir(spark)}/asof-{uuid4().hex}"
    write_table(_last_cuts(labels, history_end).filter(F.col("cut").isNotNull()), f"{folder}/open0")
    waiting = spark.read.parquet(f"{folder}/open0")
    last = waiting.agg(F.max("cut")).first()[0]
    left = sorted((m for m in months if last is not None and m <= (last.year, last.month)), reverse=True)
    answers: DataFrame | None = None
    for step in range(len(left)):
        some = left[(1 << step) - 1 : (2 << step) - 1]
        if not some or waiting.isEmpty():
            break
        rows = read(some).filter(F.col(CUSTOMER).isNotNull() & F.col("snapshot_date").isNotNull())
        picks = latest_day_by_max(_snapshot_days(rows), waiting)
        write_table(rows.join(picks, [CUSTOMER, "snapshot_date"], "left_semi").select(*rows.columns), f"{folder}/answer{step}")
        answer = spark.read.parquet(f"{folder}/answer{step}")
        answers = answer if answers is None else answers.unionByName(answer, allowMissingColumns=True)
        answered = answer.select(CUSTOMER).distinct()
        write_table(waiting.join(splittable(answered), CUSTOMER, "left_anti"), f"{folder}/open{step + 1}")
        waiting = spark.read.parquet(f"{folder}/open{step + 1}")
    return answers
