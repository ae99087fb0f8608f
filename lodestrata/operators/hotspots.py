"""Churn, coupling density and risk of files, and the repository map."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import base_name
from ..functions.scores import band, decay, tier
from ..runtime import spread, written
from .coupling import coupling_among
from .lineage import canonical
from .ownership import sole_owned

if TYPE_CHECKING:
    from ..plans.graph import RepoGraph


def hotspots(
    g: RepoGraph,
    as_of: str,
    min_commits: int = 8,
    max_files_per_commit: int = 10,
    half_life_days: float = 180.0,
    limit: int | None = None,
    kind: str = "efold",
) -> DataFrame:
    """path, module, commit_count, coupled_file_count, author_count, coupling_density, risk_score, risk_score_recent.

    For live files, over their whole rename lineage: commits and authors are distinct, recency weights sum over rows
    (a commit that touches two paths of a lineage weighs twice). Partners are counted under the names they have today,
    deleted ones included, and each weighs as the latest shared commit. A file without partners is left out.

    Paths are paired by commit and only in commits of at most max_files_per_commit files, so rows are multiplied by that at
    most. A path comes to its commit's row with the numbers of the files whose lineage it is on and of its names of today, so a
    row gives pairs of numbers as they are counted: no join follows, one aggregation by pair and one by file do. Files below
    min_commits are dropped before. A pair's weight is its latest commit's.
    """
    numbers = written(g.file.select("path", "module", "is_deleted").withColumn("number", F.monotonically_increasing_id()), "file-numbers")
    number = numbers.select("path", "number")
    lines = written(_numbered_lineage(g, numbers), "lineage")
    weight = decay(F.col("ts"), as_of, half_life_days, kind)
    # commits and files are joined once; two scans of the result follow
    touches = written(g.touches.join(number, "path").select("number", "hash", "author_email", "files_changed", weight.alias("w")), "touches")
    churn = written(_churn(lines, touches).where(F.col("commit_count") >= min_commits), "churn")
    coupled = _partners(_named(g, lines, churn, number), touches.where(F.col("files_changed") <= max_files_per_commit))
    n, k, a = F.col("commit_count"), F.col("coupled_file_count"), F.col("author_count")
    density = k / n
    out = (
        churn.join(coupled, "root")
        .join(numbers.withColumnRenamed("number", "root"), "root")
        .select(
            "path",
            "module",
            n,
            k,
            a,
            density.alias("coupling_density"),
            (density * (F.lit(1.0) / a) * F.log(n + F.lit(1))).alias("risk_score"),
            (F.try_divide("coupled_recent", "recent") * (F.lit(1.0) / a) * F.log(F.col("recent") + F.lit(1))).alias("risk_score_recent"),
        )
    )
    return out if limit is None else out.orderBy(F.desc("risk_score"), "path").limit(limit)


def _numbered_lineage(g: RepoGraph, numbers: DataFrame) -> DataFrame:
    """root, number, paths: live files by number, the numbers of the paths on their lineage, and how many these are."""
    live = numbers.where(~F.col("is_deleted"))
    own = live.select(F.col("number").alias("root"), "number")
    behind = g.renames.where("src <> dst").join(live.select(F.col("path").alias("dst"), F.col("number").alias("root")), "dst")
    behind = behind.join(numbers.select(F.col("path").alias("src"), "number"), "src").select("root", "number").distinct()
    several = behind.groupBy("root").agg((F.count("*") + 1).alias("paths"))
    return own.union(behind).join(several, "root", "left").withColumn("paths", F.coalesce("paths", F.lit(1)))


def _churn(lines: DataFrame, touches: DataFrame) -> DataFrame:
    """root, commit_count, recent, author_count. Commits are told apart where a lineage has several paths; else each row is one."""
    rows = lines.join(touches, "number").select("root", "hash", "author_email", "w", "paths")
    several = rows.where("paths > 1").groupBy("root", "hash").agg(F.first("author_email").alias("author_email"), F.sum("w").alias("w"))
    each = rows.where("paths = 1").select("root", "author_email", "w").unionByName(several.drop("hash"))
    by = each.groupBy("root", "author_email").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    return by.groupBy("root").agg(F.sum("n").alias("commit_count"), F.sum("w").alias("recent"), F.count("*").alias("author_count"))


def _named(g: RepoGraph, lines: DataFrame, churn: DataFrame, number: DataFrame) -> DataFrame:
    """number, roots, today: of each path, the counted files whose lineage it is on, and its names of today."""
    roots = lines.join(churn.select("root"), "root").select("number", "root", F.lit(None).cast("long").alias("name"))
    today = canonical(g).join(number, "path").select(F.col("number").alias("of"), F.col("canonical").alias("path")).join(number, "path")
    both = roots.union(today.select("of", F.lit(None).cast("long"), "number"))
    return both.groupBy("number").agg(F.collect_list("root").alias("roots"), F.collect_list("name").alias("today"))  # nulls are left out


def _partners(named: DataFrame, small: DataFrame) -> DataFrame:
    """root, coupled_file_count, coupled_recent of each file, from the touches of commits with few files."""
    rows = small.join(named, "number").groupBy("hash").agg(F.max("w").alias("w"), F.collect_list(F.struct("roots", "today")).alias("files"))
    each = rows.where(F.size("files") > 1).select("w", "files", F.explode("files").alias("file")).where(F.size("file.roots") > 0)
    each = each.select("w", "files", F.explode("file.roots").alias("root"))
    # what is on the file's own lineage is no partner, the file itself included
    others = F.filter("files", lambda f: ~F.array_contains(f["roots"], F.col("root")))
    lists = each.select("root", "w", F.flatten(F.transform(others, lambda f: f["today"])).alias("others"))
    pairs = spread(lists, "root").select("root", "w", F.explode("others").alias("other"))  # lists are sent, not pairs
    by_pair = pairs.groupBy("root", "other").agg(F.max("w").alias("w"))
    return by_pair.groupBy("root").agg(F.count("*").alias("coupled_file_count"), F.sum("w").alias("coupled_recent"))


def scored(g: RepoGraph, limit: int | None = None) -> DataFrame:
    """The materialized hotspots, riskiest first."""
    found = g.file_hotspot.where(F.col("risk_score").isNotNull()).orderBy(F.desc("risk_score"), "path")
    return found if limit is None else found.limit(limit)


def hotspots_or_scored(g: RepoGraph, as_of: str, limit: int = 20, min_commits: int | None = None, max_files: int | None = None) -> DataFrame:
    """The materialized table if it was made with these parameters, else the live query; scores to three places."""
    least = g.settings.min_commits if min_commits is None else min_commits
    most = g.settings.max_files_per_commit if max_files is None else max_files
    made = g.file_hotspot is not None and (least, most) == (g.settings.min_commits, g.settings.max_files_per_commit)
    found = scored(g, limit) if made else hotspots(g, as_of, least, most, g.settings.half_life_days, limit)
    names = ("coupling_density", "risk_score", "risk_score_recent")
    return found.withColumns({c: F.round(F.coalesce(c, F.lit(0.0)), 3) for c in names}).orderBy(F.desc("risk_score"), "path")


def _selected(g: RepoGraph, mode: str, top_n: int) -> DataFrame:
    score = "risk_score" if mode == "all-time" else "risk_score_recent"
    few = scored(g, max(top_n * 4, 150)).where(F.col(score).isNotNull())
    return few.withColumn("score", F.col(score)).orderBy(F.desc("score"), "path").limit(top_n)


def repo_map_nodes(g: RepoGraph, mode: str = "all-time", top_n: int = 40) -> DataFrame:
    """id, label, score, weight, sole_owned, trending_worse, band of the riskiest files.

    Mode recent ranks anew among the riskiest by the all-time score, max(4 * top_n, 150) of them.
    """
    few = written(_selected(g, mode, top_n), "selected")  # top_n rows
    most = few.agg(F.max("score").alias("most"))
    alone = sole_owned(g, few).withColumn("sole_owned", F.lit(True))
    rows = few.join(alone, "path", "left").crossJoin(F.broadcast(most))  # one row
    return rows.select(
        F.col("path").alias("id"),
        base_name(F.col("path")).alias("label"),
        "score",
        F.round(F.try_divide("score", "most"), 3).alias("weight"),
        F.coalesce("sole_owned", F.lit(False)).alias("sole_owned"),
        F.coalesce(F.col("risk_score_recent") > F.col("risk_score") * 1.1, F.lit(False)).alias("trending_worse"),
        band(F.col("score"), F.col("most")).alias("band"),
    )


def repo_map_edges(
    g: RepoGraph, mode: str = "all-time", top_n: int = 40, max_files: int = 10, min_shared: int = 3, edge_limit: int = 120
) -> DataFrame:
    """source, target, weight: shared commits over the quieter file's commits, scaled so that the largest is 10."""
    few = _selected(g, mode, top_n).select("path", "commit_count")
    pairs = coupling_among(g, few, max_files, min_shared, edge_limit)
    a, b = (few.select(F.col("path").alias(f"path_{x}"), F.col("commit_count").alias(f"n_{x}")) for x in "ab")
    dense = pairs.join(a, "path_a").join(b, "path_b").withColumn("d", F.col("shared_commits") / F.least("n_a", "n_b"))
    most = dense.agg(F.max("d").alias("most"))
    return dense.crossJoin(F.broadcast(most)).select(  # one row
        F.col("path_a").alias("source"), F.col("path_b").alias("target"), F.round(F.col("d") / F.col("most") * 10, 2).alias("weight")
    )


def with_tiers(rows: DataFrame, score: str = "risk_score") -> DataFrame:
    """rows with tier: each score against the largest among them."""
    most = rows.agg(F.max(score).alias("_most"))
    return rows.crossJoin(F.broadcast(most)).withColumn("tier", tier(F.col(score), F.col("_most"))).drop("_most")


def rerank_recent(rows: DataFrame, first: int = 12) -> DataFrame:
    """The first by risk_score, in the order of risk_score_recent."""
    top = rows.orderBy(F.desc("risk_score"), "path").limit(first)
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("risk_score_recent"), "path"))  # over `first` rows
    return top.withColumn("rank", rank)
