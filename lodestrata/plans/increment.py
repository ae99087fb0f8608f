"""Derived history tables by increment: states that merge, kept for each batch of new commits.

A batch's states are sums, counts, least and greatest values of its commits alone. They are written under the batch's number, as a
whole, so that a batch which is done again replaces what an interrupted run left of it. Derived tables merge the states of all
batches, and only those of modules that the batch touched. A batch counts once its mark is written, last of all.

Recency weights are sums of exp(-age / days) at the batch's own instant; one factor carries a sum to any other instant, so that
older sums stay as they are (see rebased).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import decay
from ..operators.coupling import module_coupling
from .graph import RepoGraph

#: Modules up to which those that a batch touched become part of a filter; more are joined.
FILTER_MODULES = 1000
MARK = "high long, as_of string, commits long"


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    """A table that may not be there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def last_mark(spark: SparkSession, root: str) -> tuple[int, int | None]:
    """The number of the last finished batch and the highest position it has taken; 0 and None before the first."""
    marks = _read(spark, f"{root}/marks")
    row = marks.orderBy(F.desc("batch")).first() if marks is not None else None
    return (row.batch, row.high) if row else (0, None)


def rebased(weight: Column, at: Column, as_of: Column | str, days: float) -> Column:
    """A sum of exp(-age / days) at one instant as the sum at another."""
    return weight * decay(at, as_of, days)


def owner_states(g: RepoGraph, as_of: str) -> DataFrame:
    """module, path, author_email, commits, additions, deletions, first_ts, last_ts, weight and its instant at."""
    about = g.commit.select("hash", "author_email", "timestamp", decay(F.col("ts"), as_of, g.settings.half_life_days).alias("w"))
    touches = g.modified.select("hash", "path", "additions", "deletions").join(about, "hash").join(g.file.select("path", "module"), "path")
    return touches.groupBy("module", "path", "author_email").agg(
        F.count("*").alias("commits"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
        F.sum("w").alias("weight"),
        F.lit(as_of).cast("timestamp").alias("at"),
    )


def author_states(g: RepoGraph) -> DataFrame:
    """email, commits, first_ts, last_ts."""
    by = g.commit.groupBy(F.col("author_email").alias("email"))
    return by.agg(F.count("*").alias("commits"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts"))


def merged_owners(states: DataFrame, as_of: str, days: float) -> DataFrame:
    """States of several batches as those of one, with weights at as_of."""
    return states.groupBy("module", "path", "author_email").agg(
        F.sum("commits").alias("commits"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum(rebased(F.col("weight"), F.col("at"), as_of, days)).alias("weight"),
        F.lit(as_of).cast("timestamp").alias("at"),
    )


def churn_of(owners: DataFrame) -> DataFrame:
    """module, path, commit_count, author_count, additions, deletions, first_ts, last_ts, top_author, top_share, recent, at: one row for
    each file. A commit has one author, so commits add up over authors. Of authors with as many commits the first by name is the top."""
    best = F.min(F.struct((-F.col("commits")).alias("n"), "author_email"))
    rows = owners.groupBy("module", "path").agg(
        F.sum("commits").alias("commit_count"),
        F.count("*").alias("author_count"),
        F.sum("additions").alias("additions"),
        F.sum("deletions").alias("deletions"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        best.alias("best"),
        F.sum("weight").alias("recent"),
        F.max("at").alias("at"),
    )
    share = -F.col("best.n") / F.col("commit_count")
    return rows.withColumns({"top_author": F.col("best.author_email"), "top_share": share}).drop("best")


def update(spark: SparkSession, root: str, newer: Callable[[int | None], RepoGraph], position: Column, as_of: str) -> dict[str, int]:
    """Takes the commits that newer(mark) gives, those whose position is above the mark, into the tables under root:

    owners (for each module, file and author) and churn (for each file), partitioned by module; authors and coupled (pairs of
    modules), which are sums of sums and small. Returns what was read and written. Without new commits nothing is written.
    """
    batch, high = last_mark(spark, root)
    g, batch = newer(high), batch + 1
    head = g.commit.agg(F.count("*").alias("n"), F.max(position).alias("high")).first()
    if not head.n:
        return {"batch": batch - 1, "commits": 0, "modules": 0}
    days, s = g.settings.half_life_days, g.settings
    at = lambda name: f"{root}/states/{name}"
    own = f"batch={batch}"
    rows = owner_states(g, as_of).hint("rebalance", "module")  # few files for a module, more for a large one
    rows.sortWithinPartitions("module", "path").write.mode("overwrite").partitionBy("module").parquet(f"{at('owners')}/{own}")
    author_states(g).write.mode("overwrite").parquet(f"{at('authors')}/{own}")
    module_coupling(g, 1, None, s.max_files_per_commit).write.mode("overwrite").parquet(f"{at('coupled')}/{own}")

    def states(name: str) -> DataFrame:
        return spark.read.option("basePath", at(name)).parquet(at(name)).where(F.col("batch") <= batch)  # what a lost run left is not read

    touched = states("owners").where(F.col("batch") == batch).select("module").distinct()
    few = [r.module for r in touched.limit(FILTER_MODULES + 1).collect()]
    old = states("owners")
    old = old.where(F.col("module").isin(few)) if len(few) <= FILTER_MODULES else old.join(touched, "module", "left_semi")
    _replace(merged_owners(old, as_of, days), f"{root}/owners")
    owners = spark.read.parquet(f"{root}/owners")
    own_rows = owners.where(F.col("module").isin(few)) if len(few) <= FILTER_MODULES else owners.join(touched, "module", "left_semi")
    _replace(churn_of(own_rows), f"{root}/churn")
    _replace(own_rows.groupBy("module", F.col("author_email").alias("email")).agg(F.count("*").alias("files")), f"{root}/author_modules")

    files = spark.read.parquet(f"{root}/author_modules").groupBy("email").agg(F.sum("files").alias("file_count"))
    commits = states("authors").groupBy("email").agg(F.sum("commits").alias("commit_count"), F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"))
    authors = commits.join(files, "email", "left").select("email", "commit_count", F.coalesce("file_count", F.lit(0)).alias("file_count"), "first_ts", "last_ts")
    authors.write.mode("overwrite").parquet(f"{root}/authors")
    pairs = states("coupled").groupBy("module_a", "module_b").agg(F.sum("shared_commits").alias("shared_commits"))
    pairs.write.mode("overwrite").parquet(f"{root}/coupled")

    mark = spark.createDataFrame([(head.high, as_of, head.n)], MARK)
    mark.coalesce(1).write.mode("overwrite").parquet(f"{root}/marks/{own}")
    return {"batch": batch, "commits": head.n, "modules": touched.count()}


def _replace(df: DataFrame, path: str) -> None:
    """Replaces the partitions of the modules in df, and no others."""
    rows = df.hint("rebalance", "module").sortWithinPartitions("module", *[c for c in ("path", "email") if c in df.columns])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("module").parquet(path)


def churn_at(spark: SparkSession, root: str, as_of: str, days: float) -> DataFrame:
    """The churn of all files, with recent at as_of: rows of modules that later batches did not touch are rebased."""
    rows = spark.read.parquet(f"{root}/churn")
    return rows.withColumn("recent", rebased(F.col("recent"), F.col("at"), as_of, days)).withColumn("at", F.lit(as_of).cast("timestamp"))
