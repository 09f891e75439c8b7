"""From raw text rows to dated rows with their calendar partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskmart.functions import parse_day_month_year
from riskmart.schemas import DATE_COLUMNS
from riskmart.sources.partitions import PARTITION_KEYS

RAW_DATE = "snapshot_date_text"


def with_calendar(raw: DataFrame) -> DataFrame:
    """Parse the date columns and add ``year``/``month``, replacing any the source had.

    The text of the snapshot date is kept in ``snapshot_date_text``. Without a snapshot
    date column every row gets a NULL date.
    """
    df = raw.drop(*PARTITION_KEYS)
    if "snapshot_date" not in df.columns:
        df = df.withColumn("snapshot_date", F.lit(None).cast(T.StringType()))
    parsed = {name: parse_day_month_year(F.col(name)) for name in DATE_COLUMNS if name in df.columns}
    return df.withColumns({RAW_DATE: F.col("snapshot_date"), **parsed}).withColumns(
        {"year": F.year("snapshot_date"), "month": F.month("snapshot_date")}
    )


def valid_rows(calendar: DataFrame) -> DataFrame:
    """Rows with a usable snapshot date."""
    return calendar.filter(F.col("snapshot_date").isNotNull()).drop(RAW_DATE)


def rejected_rows(calendar: DataFrame) -> DataFrame:
    """Rows without one, with the text that could not be parsed."""
    return calendar.filter(F.col("snapshot_date").isNull()).drop("snapshot_date", *PARTITION_KEYS)
