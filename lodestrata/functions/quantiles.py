"""Exact quantiles by refined histograms: no task, and not the driver, gets more than a bounded number of values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written

#: Buckets of a histogram, and values that are sorted in one task.
BUCKETS, FEW = 1024, 50_000


def quantile(df: DataFrame, column: str, q: float, few: int = FEW) -> float | None:
    """The interpolated quantile of a column's numbers, as SQL's percentile_cont has it; None without any. Nulls and NaN are left out.

    A pass counts the values of each bucket between the bounds, with the bucket's own least and greatest value; the next has
    the bounds of the bucket in which the wanted rank lies, until that has few values, which are sorted, or only one value.
    """
    c = F.col(column)
    values = written(df.select(c.cast("double").alias(column)).where(c.isNotNull() & ~F.isnan(c.cast("double"))), "values")
    n, low, high = values.agg(F.count("*"), F.min(column), F.max(column)).first()
    if not n:
        return None
    place = (n - 1) * q
    first = math.floor(place)
    a, b = _ranked(values, column, first, min(first + 1, n - 1), n, low, high, few)
    return a + (b - a) * (place - first)


def _ranked(values: DataFrame, column: str, i: int, j: int, n: int, low: float, high: float, few: int) -> tuple[float, float]:
    """The values at ranks i and j (i or i + 1) of n values between low and high."""
    c, before = F.col(column), 0
    while n > few and low < high:
        half = (high / 2 - low / 2) / BUCKETS  # halves, as the whole range may be beyond what a double holds
        bucket = F.least(F.floor((c / 2 - low / 2) / half), F.lit(BUCKETS - 1)) if half > 0 else (c > low).cast("long")
        rows = values.where((c >= low) & (c <= high)).groupBy(bucket.alias("b"))
        counts = rows.agg(F.count("*").alias("n"), F.min(c).alias("low"), F.max(c).alias("high")).orderBy("low").collect()
        at, sizes = before, []
        for row in counts:  # at most BUCKETS
            sizes.append((at, row))
            at += row.n
        mine, next_ = (max(k for k, (start, _) in enumerate(sizes) if start <= rank) for rank in (i, j))
        if mine != next_:  # neighbours in two buckets: the greatest of one and the least of the other
            return sizes[mine][1].high, sizes[next_][1].low
        before, row = sizes[mine]
        n, low, high = row.n, row.low, row.high
    if low == high:
        return low, low
    rows = values.where((c >= low) & (c <= high)).orderBy(column).offset(i - before).limit(j - i + 1).collect()
    return rows[0][0], rows[-1][0]
