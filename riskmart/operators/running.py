"""Running totals over a global order, without one task that sees all rows."""

from __future__ import annotations

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskmart.sources.tables import shared_dir, write_table

PART = "_part"


def totals_before(df: DataFrame, order: Sequence[Column], sums: Sequence[str], group: str | None = None) -> DataFrame:
    """``df`` with ``<c>_before`` for each of ``sums``: the total over the rows of the group that come earlier in ``order``.

    Rows with equal order count as one place only if they are one row, so group them first. The rows are range partitioned by the order and stored; totals of
    whole partitions, as many rows as partitions and groups, then shift the totals inside each. Sums must be exact types, so that the order of adding is of no account.
    """
    spark = df.sparkSession
    keys = [group] if group else []
    path = f"{shared_dir(spark)}/ordered-{uuid4().hex}"
    by_group = [F.col(group).asc_nulls_first()] if group else []
    ordered = df.repartitionByRange(*by_group, *order).withColumn(PART, F.spark_partition_id())
    write_table(ordered, path)
    stored = spark.read.parquet(path)
    whole = stored.groupBy(*keys, PART).agg(*[F.sum(c).alias(f"{c}_part") for c in sums])
    earlier = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    shifts = whole.select(*keys, PART, *[F.coalesce(F.sum(f"{c}_part").over(earlier), F.lit(0)).alias(f"{c}_shift") for c in sums])
    inside = Window.partitionBy(*keys, PART).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = stored.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    same = F.col(PART) == F.col("shift_part")
    shifts = shifts.withColumnRenamed(PART, "shift_part")
    if group:
        shifts = shifts.withColumnRenamed(group, "shift_group")
        same &= F.col(group).eqNullSafe(F.col("shift_group"))
    joined = local.join(shifts, same)
    return joined.select(*df.columns, *[(F.col(f"{c}_before") + F.col(f"{c}_shift")).alias(f"{c}_before") for c in sums])
