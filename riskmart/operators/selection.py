"""Exact quantiles of many columns by counting and narrowing ranges."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A sketch's ranks are off by about one in so many; ranges are narrowed by three times that to both sides.
ACCURACY = 10_000


def exact_quantiles(df: DataFrame, columns: Sequence[str], q: float = 0.5, accuracy: int = ACCURACY) -> dict[str, float | None]:
    """The value of rank ``ceil(q n)`` of each column, that is of the lower of two middle values for a median; None without any value.

    Missing values and NaN don't count. Each round is one aggregation of all columns that are still open: it counts exactly what lies below the column's range and
    inside it, and sketches quantiles inside to narrow it. A range that misses its rank is put right by the counts, so the
    sketch decides the number of rounds only. A few numbers per column reach the driver.
    """
    if not columns:
        return {}
    number = {c: F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")) for c in columns}
    first = df.agg(*[F.struct(F.count(v), F.min(v), F.max(v)).alias(f"v{i}") for i, v in enumerate(number.values())]).first()
    result: dict[str, float | None] = {}
    outer, guess, rank = {}, {}, {}
    for c, (n, low, high) in zip(columns, first, strict=True):
        if not n:
            result[c] = None
            continue
        rank[c] = max(1, ceil(q * n))
        outer[c] = guess[c] = (low, high)
    share = 3 / accuracy
    while open_ := [c for c in columns if c not in result]:
        parts = []
        for i, c in enumerate(open_):
            v, (low, high), (least, most) = number[c], guess[c], outer[c]
            inside = F.when((v >= low) & (v <= high), v)
            parts.append(
                F.struct(
                    F.count(F.when(v < low, 1)).alias("below"),
                    F.count(inside).alias("inside"),
                    F.min(inside).alias("low"),
                    F.max(inside).alias("high"),
                    F.max(F.when((v < low) & (v >= least), v)).alias("before"),
                    F.min(F.when((v > high) & (v <= most), v)).alias("after"),
                    F.percentile_approx(inside, [x / 1000 for x in range(0, 1001)], accuracy).alias("sketch"),
                ).alias(f"v{i}")
            )
        found = df.agg(*parts).first()
        for i, c in enumerate(open_):
            f, (least, most) = found[f"v{i}"], outer[c]
            if rank[c] <= f.below:  # the range was too high
                outer[c] = guess[c] = (least, f.before)
            elif rank[c] > f.below + f.inside:  # too low
                outer[c] = guess[c] = (f.after, most)
            elif f.low == f.high:
                result[c] = f.low
            else:
                place = (rank[c] - f.below) / f.inside
                low = f.sketch[max(0, int((place - share) * 1000))]
                high = f.sketch[min(1000, ceil((place + share) * 1000))]
                outer[c] = (f.low, f.high)
                narrower = (max(low, f.low), min(high, f.high))
                if narrower == (f.low, f.high):  # few values are left, or most are equal: keep one end
                    middle = f.sketch[min(1000, max(0, round(place * 1000)))]
                    narrower = (f.low, f.low) if middle == f.low else (middle, middle)
                guess[c] = narrower
    return {c: result[c] for c in columns}
