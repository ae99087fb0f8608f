"""Derived tables, computed once with the default parameters: hotspots before criticality."""

from __future__ import annotations

from dataclasses import replace

from ..operators.coupling import module_coupling
from ..operators.hotspots import hotspots
from ..operators.ownership import author_stats, criticality
from ..runtime import written
from .graph import RepoGraph


def materialize(g: RepoGraph, as_of: str, only: tuple[str, ...] | None = None, path: str | None = None) -> RepoGraph:
    """g with file_hotspot, author_stats, author_criticality and coupled_with as tables, under path or in shared storage.

    Earlier tables are overwritten, never merged into, so that nothing stale stays. only: the names of those to make.
    """
    s = g.settings
    keep = lambda df, name: written(df, name, path and f"{path}/{name}")
    g = replace(g, file_hotspot=keep(hotspots(g, as_of, s.min_commits, s.max_files_per_commit, s.half_life_days), "file_hotspot"))
    made = {
        "author_stats": lambda: author_stats(g),
        "author_criticality": lambda: criticality(g),
        "coupled_with": lambda: module_coupling(g, s.module_min_count, None, s.max_files_per_commit),
    }
    return replace(g, **{n: keep(make(), n) for n, make in made.items() if only is None or n in only})
