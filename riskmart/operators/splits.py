"""Train and test splits that do not depend on how the data is partitioned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmart.config import TEST_LAST_N_MONTHS
from riskmart.functions import month_key

MONTH = "pred_month"


def prediction_months(df: DataFrame) -> DataFrame:
    """Distinct calendar months of the prediction date, ascending."""
    return (
        df.select(month_key(F.col("prediction_date")).alias(MONTH))
        .filter(F.col(MONTH).isNotNull())
        .distinct()
        .orderBy(MONTH)
    )


def oot_split(df: DataFrame, last_n_months: int = TEST_LAST_N_MONTHS) -> tuple[DataFrame, DataFrame]:
    """Out-of-time split: (all earlier months, the last months). Undated rows are in neither.

    The list of test months has at most ``last_n_months`` rows, so broadcasting it is safe.
    """
    test_months = F.broadcast(prediction_months(df).orderBy(F.desc(MONTH)).limit(last_n_months))
    dated = df.withColumn(MONTH, month_key(F.col("prediction_date"))).filter(F.col(MONTH).isNotNull())
    train = dated.join(test_months, MONTH, "left_anti").drop(MONTH)
    test = dated.join(test_months, MONTH, "left_semi").drop(MONTH)
    return train, test


def hash_bucket(*keys: str) -> Column:
    """Bucket 0-99 from the key's MD5, the same on every run, cluster and engine."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % 100).cast("int")


def hash_split(df: DataFrame, *keys: str, train_percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Random split by key: a key is always on the same side."""
    in_train = hash_bucket(*keys) < train_percent
    return df.filter(in_train), df.filter(~in_train)
