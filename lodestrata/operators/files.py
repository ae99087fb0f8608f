"""Repository statistics, file details, module list and search."""

from __future__ import annotations

from dataclasses import replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import contains_ci
from ..runtime import fresh_path, spread
from . import trigrams
from .lineage import on_lineage
from .ownership import author_list

if TYPE_CHECKING:
    from ..plans.graph import RepoGraph


def repo_stats(g: RepoGraph) -> DataFrame:
    """One row of counts and first and last timestamps, compared as text; zeros for an empty graph."""
    commits = g.commit.agg(
        F.count("*").alias("commit_count"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")
    )
    files = g.file.agg(F.count("*").alias("file_count"), F.countDistinct("module").alias("module_count"))
    authors = g.author.agg(F.count("*").alias("author_count"))
    out = files.crossJoin(commits).crossJoin(authors)  # one row each
    return out.select("file_count", "commit_count", "author_count", "module_count", "first_ts", "last_ts")


def file_detail(g: RepoGraph, path: str) -> DataFrame:
    """A file over its lineage; a commit that touches two of its paths counts twice. One row per outgoing rename."""
    f = g.file.where(F.col("path") == path)
    sums = on_lineage(g, path, g.touches).groupBy(F.lit(path).alias("root")).agg(
        F.count("*").alias("commit_count"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")
    )
    out = f.join(sums, F.col("path") == F.col("root"), "left").join(
        g.renamed_to.select(F.col("old_path").alias("path"), F.col("new_path").alias("renamed_to")), "path", "left"
    )
    risk = g.file_hotspot
    scores = ["risk_score", "risk_score_recent"]
    out = out.join(risk.select("path", *scores), "path", "left") if risk is not None else out.withColumns({c: F.lit(None).cast("double") for c in scores})
    return out.select(
        "path", "extension", "module", "is_deleted", F.coalesce("commit_count", F.lit(0)).alias("commit_count"),
        "first_ts", "last_ts", "renamed_to", *scores,
    )


def file_recent_commits(g: RepoGraph, path: str, limit: int = 15) -> DataFrame:
    """hash, message, author_name, timestamp, additions, deletions; a commit once for each path of the lineage it touched."""
    rows = on_lineage(g, path, g.modified).select("hash", "path", "additions", "deletions")
    about = g.commit.select("hash", "message", "author_email", "timestamp")
    rows = rows.join(about, "hash").join(g.author.select(F.col("email").alias("author_email"), F.col("name").alias("author_name")), "author_email")
    rows = rows.orderBy(F.desc("timestamp"), "hash", "path").limit(limit)
    return rows.select("hash", "message", "author_name", "timestamp", "additions", "deletions")


def module_list(g: RepoGraph) -> DataFrame:
    """name, file_count, commit_count, author_count of modules with live files, files without commits included."""
    live = g.live_files.select("path", F.col("module").alias("name"))
    files = live.groupBy("name").agg(F.count("*").alias("file_count"))
    seen = live.join(spread(g.touches.select("path", "hash", "author_email"), "path"), "path").select("name", "hash", "author_email").distinct()  # a commit touches many files of a module
    sums = seen.groupBy("name").agg(F.count("*").alias("commit_count"), F.countDistinct("author_email").alias("author_count"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("commit_count", "author_count")]
    return files.join(sums, "name", "left").select("name", "file_count", *zero).orderBy(F.desc("commit_count"), "name")


def list_files(g: RepoGraph, search: str = "", limit: int = 50, sort: str = "commits") -> DataFrame:
    """Files whose path holds search, with their own path's commits and risk; sort: commits or risk (nulls last)."""
    few = g.file.where(contains_ci(F.col("path"), search)).select("path", "extension", "module", "is_deleted")
    counts = g.modified.join(few.select("path"), "path", "left_semi").groupBy("path").agg(F.count("*").alias("commit_count"))
    out = few.join(counts, "path", "left").withColumn("commit_count", F.coalesce("commit_count", F.lit(0)))
    if g.file_hotspot is not None:
        out = out.join(g.file_hotspot.select("path", "risk_score"), "path", "left")
    else:
        out = out.withColumn("risk_score", F.lit(None).cast("double"))
    order = [F.desc("commit_count"), F.col("path")]
    return out.orderBy(*([F.desc_nulls_last("risk_score")] if sort == "risk" else []), *order).limit(limit)


def search_commits(g: RepoGraph, q: str, limit: int = 8) -> DataFrame:
    found = g.commit.where(contains_ci(F.col("message"), q)).join(g.author.withColumnRenamed("email", "author_email"), "author_email")
    found = found.orderBy(F.desc("timestamp"), "hash").limit(limit)
    return found.select("hash", "message", F.col("name").alias("author_name"), "timestamp")


def text_index(rows: DataFrame, key: str, text: str) -> DataFrame:
    """A written search index of text by a key that is not a number, in shared storage."""
    path = fresh_path(rows.sparkSession, "trigrams")
    trigrams.write(trigrams.postings(rows, key, text, trigrams.hashed_bits(rows.count())), path)
    return rows.sparkSession.read.schema(trigrams.SCHEMA).parquet(path)


def search_commits_indexed(g: RepoGraph, index: DataFrame, q: str, limit: int = 8) -> DataFrame:
    """search_commits, which reads only the commits that an index of hash and message names."""
    return search_commits(replace(g, commit=trigrams.find(g.commit, index, "hash", "message", q)), q, limit)


def list_files_indexed(g: RepoGraph, index: DataFrame, q: str, limit: int = 50, sort: str = "commits") -> DataFrame:
    """list_files, which reads only the files that an index of path names."""
    return list_files(replace(g, file=trigrams.find(g.file, index, "path", "path", q)), q, limit, sort)


def search(g: RepoGraph, q: str, limit: int = 8) -> dict[str, DataFrame]:
    """Files, authors and commits that hold q."""
    return {"files": list_files(g, q, limit), "authors": author_list(g, q, limit), "commits": search_commits(g, q, limit)}
