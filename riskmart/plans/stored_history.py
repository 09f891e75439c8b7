"""Stored history: what each day adds to the sums and moments of a loan or customer, in month-partitioned tables.

Days of a batch are merged into the stored days of its months; nothing older is read. Over silver that is kept month by month, the days of changed months are
replaced instead. Either way the aggregates up to any prediction date come from the day tables, without the daily rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.operators.history import AMOUNTS, CUSTOMER, click_days, loan_days, merged_click_days
from riskmart.plans.bronze import LEDGERS
from riskmart.sources import Ledger, exists, read_months, remove, write_partitions, write_table
from riskmart.sources.ledger import Month, month_dir, month_name, month_of
from riskmart.sources.partitions import PARTITION_KEYS
from riskmart.sources.tables import read_text, write_text

BATCHES = "_batches.json"
HISTORY = "history"


def _by_month(days: DataFrame, day: str) -> DataFrame:
    return days.withColumns({"year": F.year(day), "month": F.month(day)})


def add_days(
    spark: SparkSession, path: str, days: DataFrame, merge: Callable[[DataFrame], DataFrame], day: str, batch: str
) -> list[Month]:
    """Merge a batch's days into the table at ``path`` and return its months.

    A batch counts once, however often it is given: its months are merged into a table beside first, the ledger of batches names that table, and
    a run that broke off in between starts by putting it in place.
    """
    ledger = json.loads(read_text(spark, f"{path}/{BATCHES}") or '{"batches": [], "pending": null}')
    if ledger["pending"]:
        _put(spark, path, ledger)
    if batch in ledger["batches"]:
        return []
    fresh = _by_month(days.filter(F.col(day).isNotNull()), day)
    months = sorted((r.year, r.month) for r in fresh.select(*PARTITION_KEYS).distinct().collect())
    stored = _read_folders(spark, path, months)
    together = fresh.drop(*PARTITION_KEYS)
    if stored is not None:
        together = together.unionByName(stored)
    staging = f"{path}-{uuid4().hex}"
    write_table(_by_month(merge(together), day), staging)
    ledger["pending"] = {"batch": batch, "staging": staging}
    write_text(spark, f"{path}/{BATCHES}", json.dumps(ledger))
    _put(spark, path, ledger)
    return months


def _put(spark: SparkSession, path: str, ledger: dict) -> None:
    staging = ledger["pending"]["staging"]
    if exists(spark, staging):
        write_partitions(spark.read.parquet(staging), path)
    ledger["batches"].append(ledger["pending"]["batch"])
    ledger["pending"] = None
    write_text(spark, f"{path}/{BATCHES}", json.dumps(ledger))
    remove(spark, staging)


def add_loan_days(spark: SparkSession, path: str, loan_daily: DataFrame, batch: str) -> list[Month]:
    daily = loan_daily.select("loan_id", CUSTOMER, "snapshot_date", *AMOUNTS.values())  # loan_days takes rows and days alike
    return add_days(spark, path, daily, loan_days, "snapshot_date", batch)


def add_click_days(spark: SparkSession, path: str, clicks: DataFrame, batch: str) -> list[Month]:
    return add_days(spark, path, click_days(clicks), merged_click_days, "day", batch)


def read_days(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(*PARTITION_KEYS)


def update_history(spark: SparkSession, silver_path: str) -> dict[str, list[Month]]:
    """Day tables beside silver for the months that were built again since; those of months that went go too."""
    changed = {}
    for table, build, day in (("loan_daily", loan_days, "snapshot_date"), ("clickstream", click_days, "day")):
        silver = Ledger.read(spark, f"{silver_path}/{LEDGERS}/{table}")
        path, ledger_path = f"{silver_path}/{HISTORY}/{table}", f"{silver_path}/{HISTORY}/{LEDGERS}/{table}"
        own = Ledger.read(spark, ledger_path) or Ledger()
        builds = silver.builds()
        known = {month_of(m): f["source"] for m, f in own.months.items() if m not in own.pending}
        stale = sorted(m for m, b in builds.items() if known.get(m) != b)
        gone = sorted({*map(month_of, own.months), *map(month_of, own.pending)} - set(builds))
        changed[table] = [*stale, *gone]
        if not changed[table]:
            continue
        own.pending = [month_name(m) for m in changed[table]]
        own.write(spark, ledger_path)
        for month in changed[table]:
            remove(spark, month_dir(path, month))
        write_partitions(_by_month(build(read_months(spark, f"{silver_path}/{table}", silver, stale)), day), path)
        own.months = {month_name(m): {"source": b} for m, b in builds.items()}
        own.pending = []
        own.write(spark, ledger_path)
    return changed


def read_history(spark: SparkSession, silver_path: str, table: str, months: list[Month]) -> DataFrame | None:
    """The days of the given months; None where there are none."""
    return _read_folders(spark, f"{silver_path}/{HISTORY}/{table}", months)


def _read_folders(spark: SparkSession, path: str, months: list[Month]) -> DataFrame | None:
    folders = [f for f in (month_dir(path, m) for m in months) if exists(spark, f)]
    return spark.read.option("basePath", path).parquet(*folders).drop(*PARTITION_KEYS) if folders else None
