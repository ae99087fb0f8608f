"""Logical coupling: files and modules that change in the same commits."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import canonical, on_lineage

if TYPE_CHECKING:
    from ..plans.graph import RepoGraph


def co_changes(g: RepoGraph, path: str, min_count: int = 1, limit: int = 15, max_files: int = 10) -> DataFrame:
    """path, module, shared_commits of live files that change together with a file; also its direct blast radius.

    The file counts with all the paths it was renamed from, a partner under the names it has today.
    """
    small = g.small_touches(max_files).select("hash", "path")
    commits = on_lineage(g, path, small).select("hash").distinct()
    others = on_lineage(g, path, small.join(commits, "hash", "left_semi"), inside=False)
    shared = (
        others.join(canonical(g), "path")
        .groupBy(F.col("canonical").alias("path"))
        .agg(F.countDistinct("hash").alias("shared_commits"))
        .where(F.col("shared_commits") >= min_count)
    )
    found = shared.join(g.live_files.select("path", "module"), "path").select("path", "module", "shared_commits")
    return found.orderBy(F.desc("shared_commits"), "path").limit(limit)


def blast_radius_direct(g: RepoGraph, path: str, min_count: int = 2, limit: int = 12, max_files: int = 10) -> DataFrame:
    return co_changes(g, path, min_count, limit, max_files)


def blast_radius_transitive(g: RepoGraph, path: str, min_count: int = 2, limit: int = 24, max_files: int = 10) -> DataFrame:
    """via, path, module, shared_commits: what changes together with the live files that change together with a file.

    Own paths only; the first step needs one shared commit, the second min_count. From the file outward: only the
    commits of its neighbours are joined with themselves.
    """
    small = g.small_touches(max_files).select("hash", "path")
    live = g.live_files.select("path", "module")
    commits = small.where(F.col("path") == path).select("hash").distinct()
    direct = small.join(commits, "hash", "left_semi").where(F.col("path") != path).select("path").distinct()
    direct = direct.join(live, "path", "left_semi").select(F.col("path").alias("via"))
    through = small.join(direct, F.col("path") == F.col("via")).select("hash", "via")
    shared = (
        through.join(small, "hash")
        .where((F.col("path") != path) & (F.col("path") != F.col("via")))
        .groupBy("via", "path")
        .agg(F.countDistinct("hash").alias("shared_commits"))
        .where(F.col("shared_commits") >= min_count)
    )
    found = shared.join(live, "path").select("via", "path", "module", "shared_commits")
    return found.orderBy(F.desc("shared_commits"), "via", "path").limit(limit)


def module_coupling(g: RepoGraph, min_count: int = 2, limit: int | None = 25, max_files: int = 10) -> DataFrame:
    """module_a, module_b, shared_commits over commits of 2 to max_files files; modules are folded per commit first."""
    small = g.small_touches(max_files).where(F.col("files_changed") >= 2).select("hash", "path")
    touched = small.join(g.file.select("path", "module"), "path").select("hash", "module").distinct()
    a, b = touched.withColumnRenamed("module", "module_a"), touched.withColumnRenamed("module", "module_b")
    found = (
        a.join(b, "hash")
        .where("module_a < module_b")
        .groupBy("module_a", "module_b")
        .agg(F.count("*").alias("shared_commits"))
        .where(F.col("shared_commits") >= min_count)
    )
    return found if limit is None else found.orderBy(F.desc("shared_commits"), "module_a", "module_b").limit(limit)


def module_coupling_or_made(g: RepoGraph, min_count: int = 2, limit: int = 25, max_files: int = 10) -> DataFrame:
    """The materialized table if it was made with these parameters, else the live query."""
    if g.coupled_with is not None and (min_count, max_files) == (g.settings.module_min_count, g.settings.max_files_per_commit):
        return g.coupled_with.orderBy(F.desc("shared_commits"), "module_a", "module_b").limit(limit)
    return module_coupling(g, min_count, limit, max_files)


def module_graph_nodes(edges: DataFrame) -> DataFrame:
    """module, total, weight: shared commits over all edges of a module, and its share of the largest."""
    ends = edges.select(F.col("module_a").alias("module"), "shared_commits").union(edges.select("module_b", "shared_commits"))
    totals = ends.groupBy("module").agg(F.sum("shared_commits").alias("total"))
    most = totals.agg(F.max("total").alias("most"))
    return totals.crossJoin(F.broadcast(most)).select("module", "total", F.round(F.col("total") / F.col("most"), 3).alias("weight"))


def coupling_among(g: RepoGraph, files: DataFrame, max_files: int = 10, min_shared: int = 3, limit: int = 120) -> DataFrame:
    """path_a, path_b, shared_commits of pairs among files (path)."""
    small = g.small_touches(max_files).select("hash", "path").distinct()
    touched = small.join(files.select("path").distinct(), "path", "left_semi")
    a, b = touched.withColumnRenamed("path", "path_a"), touched.withColumnRenamed("path", "path_b")
    found = (
        a.join(b, "hash")
        .where("path_a < path_b")
        .groupBy("path_a", "path_b")
        .agg(F.count("*").alias("shared_commits"))
        .where(F.col("shared_commits") >= min_shared)
    )
    return found.select("path_a", "path_b", "shared_commits").orderBy(F.desc("shared_commits"), "path_a", "path_b").limit(limit)
