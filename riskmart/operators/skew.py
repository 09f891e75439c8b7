"""Keeping joins on hot keys splittable."""

from __future__ import annotations

from pyspark.sql import DataFrame

# More partitions than any plan has: coalescing to it moves no data.
_ANY_NUMBER = 1 << 30


def splittable(df: DataFrame) -> DataFrame:
    """Prepare the side of a join that has few rows per key, where the other may be hot.

    AQE splits a hot key only if both sides of the join come straight from a shuffle. The
    result of an aggregation or join is already partitioned by its key, so Spark would put
    it into the next join as it is and the hot key of the other side would stay in one
    task. Coalescing drops that knowledge, not the partitions, and the join shuffles this
    side once more; it is the small one.
    """
    return df.coalesce(_ANY_NUMBER)
