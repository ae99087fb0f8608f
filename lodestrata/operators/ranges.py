"""Joins of line ranges by bins.

Ranges are cut at the borders of bins of WIDTH lines, and meet by path and bin. A pair that meets in several bins counts in the one
where its common part begins, so nothing is doubled and nothing is to be made distinct. The hunks of a bin that many share are
dealt to parts, each of which gets the few functions of that bin: no task has all hunks of a path, or of a bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import written

#: Lines of a bin: about the length of a function, so that most ranges have one or two bins.
WIDTH = 64
#: Hunks of a bin that one task gets.
HOT = 10_000
#: Bins at most that are broadcast with their numbers of parts: of more, only those with more hunks are split.
HOT_BINS = 100_000


def _bins(low: Column, high: Column) -> Column:
    """The bins of a range's lines; none of an empty one."""
    first, last = (F.floor(x / WIDTH).cast("long") for x in (low, high))
    return F.explode(F.when(high >= low, F.sequence(first, F.greatest(first, last))).otherwise(F.array().cast("array<bigint>")))


def overlapping(spans: DataFrame, hunks: DataFrame, hot: int = HOT) -> DataFrame:
    """Each pair of spans (path, start_line, end_line and more) and hunks (path, lo, hi and more) of a path with a line in common, once:
    all columns of both. Rows with a null path or line, and empty ranges, meet nothing. hot: for tests."""
    cut = hunks.withColumn("_bin", _bins(F.col("lo"), F.col("hi"))).where("path is not null")
    own = spans.withColumn("_bin", _bins(F.col("start_line"), F.col("end_line")))
    counts = written(cut.groupBy("path", "_bin").agg(F.count("*").alias("_n")).where(F.col("_n") > hot), "full-bins")
    n = counts.agg(F.sum("_n")).first()[0]
    if n:
        often = max(hot, n // HOT_BINS)
        parts = counts.where(F.col("_n") > often).select("path", "_bin", F.ceil(F.col("_n") / often).alias("_parts"))
        part = lambda rows: rows.join(F.broadcast(parts), ["path", "_bin"], "left")
        deal = F.pmod(F.monotonically_increasing_id(), F.col("_parts"))
        cut = part(cut).withColumn("_part", F.coalesce(deal, F.lit(0))).drop("_parts")
        own = part(own).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    else:
        cut, own = (rows.withColumn("_part", F.lit(0).cast("long")) for rows in (cut, own))
    meet = own.join(cut, ["path", "_bin", "_part"]).where((F.col("lo") <= F.col("end_line")) & (F.col("hi") >= F.col("start_line")))
    begins = F.floor(F.greatest("lo", "start_line") / WIDTH)
    return meet.where(begins == F.col("_bin")).drop("_bin", "_part")
