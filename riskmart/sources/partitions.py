"""Parquet partitioned by year and month of the snapshot date."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskmart.sources.tables import make_dir, remove, rename

PARTITION_KEYS = ("year", "month")


def write_partitions(df: DataFrame, path: str) -> None:
    """Replace the months present in ``df``; other months under ``path`` stay.

    The rebalance hint gathers each month into few files of the advisory size and lets
    AQE split a month that is far larger than the others, so no task holds a whole hot month.
    """
    (
        df.hint("rebalance", *PARTITION_KEYS)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*PARTITION_KEYS)
        .parquet(path)
    )


def read_partitions(
    spark: SparkSession, path: str, months: Iterable[tuple[int, int]] | None = None
) -> DataFrame:
    """Read a partitioned table, or only the given (year, month) directories of it."""
    df = spark.read.parquet(path)
    if months is None:
        return df
    wanted = [(F.col("year") == year) & (F.col("month") == month) for year, month in months]
    return df.filter(reduce(lambda a, b: a | b, wanted, F.lit(False)))


def move_partitions(spark: SparkSession, staging: str, path: str, months: Iterable[tuple[int, int]]) -> None:
    """Replace the given months of the table at ``path`` by those written below ``staging``, a folder of the same file system."""
    for year, month in months:
        place = f"year={year}/month={month}"
        remove(spark, f"{path}/{place}")
        make_dir(spark, f"{path}/year={year}")
        rename(spark, f"{staging}/{place}", f"{path}/{place}")
