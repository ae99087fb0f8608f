"""Rename lineage: closures of rename edges, the paths behind a file and the paths ahead of it."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written

if TYPE_CHECKING:
    from ..plans.graph import RepoGraph


def closure(edges: DataFrame, max_hops: int = 20) -> DataFrame:
    """(src, dst, depth) of all pairs within max_hops steps of edges (src, dst), at their least depth.

    Path doubling: each round joins what is known with itself, so max_hops are covered in log2(max_hops) rounds; the
    grouping makes cycles end. Only pairs are kept, never paths.
    """
    reach = written(edges.select("src", "dst").distinct().withColumn("depth", F.lit(1)), "closure")
    size, covered = reach.count(), 1
    while covered < max_hops and size:
        a, b = reach.alias("a"), reach.alias("b")
        longer = a.join(b, F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst", (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        grown = reach.unionByName(longer.where(F.col("depth") <= max_hops)).groupBy("src", "dst").agg(F.min("depth").alias("depth"))
        reach, before = written(grown, "closure"), size
        size, covered = reach.count(), covered * 2
        if size == before:
            break
    return reach


def lineage(g: RepoGraph, roots: DataFrame | None = None) -> DataFrame:
    """(root, path): every file with itself and each path it was ever renamed from. roots (path) limits the files."""
    roots = (g.file if roots is None else roots).select(F.col("path").alias("root"))
    behind = g.renames.select(F.col("dst").alias("root"), F.col("src").alias("path"))
    behind = behind.join(roots, "root", "left_semi")
    behind = behind.join(g.file.select("path"), "path", "left_semi").select("root", "path")
    return roots.select("root", F.col("root").alias("path")).union(behind).distinct()


#: Paths of one file's lineage that become part of a filter, which reaches the scan; more are joined.
FILTER_PATHS = 1000


def on_lineage(g: RepoGraph, path: str, rows: DataFrame, inside: bool = True) -> DataFrame:
    """The rows (path) on a file's lineage, or all others."""
    own = lineage(g, g.file.where(F.col("path") == path)).select("path")
    few = [r.path for r in own.limit(FILTER_PATHS + 1).collect()]
    if len(few) > FILTER_PATHS:
        return rows.join(own, "path", "left_semi" if inside else "left_anti")
    found = F.col("path").isin(few) if few else F.lit(False)
    return rows.where(found if inside else ~found)


def canonical(g: RepoGraph) -> DataFrame:
    """(path, canonical): what each file is called today: what is ahead of it, itself included, and not renamed again.

    A branch has several; a path that only leads into a cycle has none.
    """
    own = g.file.select("path", F.col("path").alias("canonical"))
    ahead = g.renames.select(F.col("src").alias("path"), F.col("dst").alias("canonical"))
    old = g.renamed_to.select(F.col("old_path").alias("canonical"))
    return own.union(ahead).distinct().join(old, "canonical", "left_anti").select("path", "canonical")


def mark_deleted(files: DataFrame, live_paths: DataFrame) -> DataFrame:
    """files with is_deleted set where the path is not among live_paths (path)."""
    live = live_paths.select("path").distinct().withColumn("_live", F.lit(True))
    kept = [c for c in files.columns if c != "is_deleted"]
    return files.select(*kept).join(live, "path", "left").withColumn("is_deleted", F.col("_live").isNull()).drop("_live")


def rename_history(files: DataFrame, renamed_to: DataFrame) -> DataFrame:
    """files with has_rename_history set where the path is what another was renamed to."""
    new = renamed_to.select(F.col("new_path").alias("path")).distinct().withColumn("_new", F.lit(True))
    kept = [c for c in files.columns if c != "has_rename_history"]
    return files.select(*kept).join(new, "path", "left").withColumn("has_rename_history", F.col("_new").isNotNull()).drop("_new")
