"""Column functions: ages and decays, function risk, tiers, percentiles and rank correlation."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import written


def instant(value: Column | str) -> Column:
    """A timestamp, given as a column or as text (UTC)."""
    return (F.lit(value) if isinstance(value, str) else value).cast("timestamp")


def age_days(ts: Column, as_of: Column | str) -> Column:
    return (F.unix_timestamp(instant(as_of)) - F.unix_timestamp(ts.cast("timestamp"))) / 86400.0


def decay(ts: Column, as_of: Column | str, days: float, kind: str = "efold") -> Column:
    """exp(-age / days); kind half_life: 2 ** (-age / days)."""
    rate = math.log(2) if kind == "half_life" else 1.0
    return F.exp(-age_days(ts, as_of) / days * rate)


def is_stale(last: Column, as_of: Column | str, days: int = 180) -> Column:
    """Whether more than days whole days have passed."""
    return F.floor(age_days(last, as_of)) > days


def relative_age(ts: Column, as_of: Column | str) -> Column:
    """today, days below 30, months below a year, else years to one place."""
    days = F.floor(age_days(ts, as_of))
    return (
        F.when(days < 1, F.lit("today"))
        .when(days < 30, F.format_string("%dd ago", days))
        .when(days < 365, F.format_string("%dmo ago", F.round(days / 30).cast("int")))
        .otherwise(F.format_string("%.1fy ago", days / 365))
    )


def function_risk(changes: Column, callers: Column, complexity: Column) -> Column:
    return F.round(F.log1p(changes) * F.log1p(callers) * F.log1p(complexity), 4)


def tier(score: Column, most: Column) -> Column:
    """Of a score against the list's largest: quarters named from good to critical."""
    share = F.when(most > 0, score / most)
    return F.when(share >= 0.75, "critical").when(share >= 0.5, "serious").when(share >= 0.25, "warning").otherwise("good")


def band(score: Column, most: Column) -> Column:
    """Thirds of the largest score: high, medium, low."""
    share = F.when(most > 0, score / most)
    return F.when(share >= 0.66, "high").when(share >= 0.33, "medium").otherwise("low")


def strength(rho: Column) -> Column:
    size = F.abs(rho)
    word = F.when(size < 0.1, "negligible").when(size < 0.3, "weak").when(size < 0.5, "moderate").otherwise("strong")
    return F.concat(word, F.when(size < 0.1, "").when(rho < 0, " negative").otherwise(" positive"))


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """n, rho: correlation of average ranks; 0 for fewer than two rows or no variance.

    Ranks come from counts of distinct values, dealt by ranges of values: a running sum within each range, and one over the
    ranges' sums, of which there are as many as partitions.
    """
    rows = df.select(F.col(x).alias("x"), F.col(y).alias("y")).where("x is not null and y is not null")
    rows = written(rows, "pairs")  # read three times

    def ranks(c: str) -> DataFrame:
        counts = rows.groupBy(c).agg(F.count("*").alias("n")).repartitionByRange(c).withColumn("part", F.spark_partition_id())
        counts = written(counts, "counts")
        before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        parts = counts.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(before, F.lit(0)).alias("base"))
        within = F.sum("n").over(Window.partitionBy("part").orderBy(c).rowsBetween(Window.unboundedPreceding, -1))
        placed = counts.withColumn("within", F.coalesce(within, F.lit(0))).join(F.broadcast(parts), "part")  # one row a partition
        return placed.select(c, (F.col("base") + F.col("within") + (F.col("n") + 1) / 2.0).alias(f"r{c}"))

    both = rows.join(ranks("x"), "x").join(ranks("y"), "y")
    spread = F.stddev_pop("rx") * F.stddev_pop("ry")
    rho = F.try_divide(F.covar_pop("rx", "ry"), spread)
    return both.agg(F.count("*").alias("n"), F.coalesce(rho, F.lit(0.0)).alias("rho"))


def contains_ci(column: Column, text: str) -> Column:
    """Whether column holds text, whatever the case; no wild cards; the empty text is in all."""
    return F.lower(column).contains(text.lower())
