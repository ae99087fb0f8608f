"""Shortest paths between authors over the files they have touched, of any length up to a bound.

Both ends grow by turns, level by level, and the paths meet at a file: whether the files of one end's last authors are among
those of the other's is seen by a join of two sets of files, before any file is opened to all its authors. So the files that
everybody has touched are opened last, and only if no shorter path went through them. A level is a set of authors, each with
the file and author it was reached from; one path's rows come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written

#: Longest path in edges between an author and a file, two for each author.
MAX_HOPS = 12


class _End:
    """What one end has reached: levels of (email, path, former), and the files of the last one as (path, email)."""

    def __init__(self, touched: DataFrame, email: str):
        self.touched, self.levels = touched, []
        start = touched.where(F.col("email") == email).select("email").distinct()
        self.add(start.select("email", F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("former")))

    def add(self, level: DataFrame) -> None:
        self.levels.append(written(level, "path-authors"))
        files = self.touched.join(self.levels[-1].select("email"), "email").groupBy("path").agg(F.min("email").alias("email"))
        # a file of an earlier level would have led there
        for before in self.levels[:-1]:
            old = self.touched.join(before.select("email"), "email").select("path").distinct()
            files = files.join(old, "path", "left_anti")
        self.files = written(files, "path-files")
        self.size = self.files.count()

    def grow(self) -> None:
        """Opens the last files to all their authors; of ways to reach one the first by file and author counts."""
        ways = self.touched.join(self.files.withColumnRenamed("email", "former"), "path")
        new = ways.groupBy("email").agg(F.min(F.struct("path", "former")).alias("way"))
        for before in self.levels:
            new = new.join(before.select("email"), "email", "left_anti")
        self.add(new.select("email", "way.path", "way.former"))

    def back(self, email: str) -> list[str]:
        """From an author of the last level to the start: author, file, author, ..."""
        steps = [email]
        for level in reversed(self.levels[1:]):
            row = level.where(F.col("email") == steps[-1]).first()
            steps += [row.path, row.former]
        return steps


def shortest(touched: DataFrame, a: str, b: str, max_hops: int = MAX_HOPS) -> list[str] | None:
    """Authors and files by turns from a to b, over rows (email, path); None if there is no path of max_hops edges.

    Of shortest paths one is taken by fixed rules: the first meeting by the authors beside it, a's first, and its file, and
    on both sides the first file, then author, that each was reached from. The same author is a path of no edges.
    """
    touched = written(touched.select("email", "path").where("email is not null and path is not null").distinct(), "touched")
    ends = _End(touched, a), _End(touched, b)
    if not (ends[0].size and ends[1].size):
        return None
    if a == b:
        return [a]
    while True:
        edges = 2 * (len(ends[0].levels) + len(ends[1].levels) - 1)
        if edges > max_hops or not (ends[0].size and ends[1].size):
            return None
        one, other = (e.files.select("path", F.col("email").alias(c)) for e, c in zip(ends, ("one", "other")))
        met = one.join(other, "path").orderBy("one", "other", "path").first()
        if met:
            return [*reversed(ends[0].back(met.one)), met.path, *ends[1].back(met.other)]
        (ends[0] if ends[0].size <= ends[1].size else ends[1]).grow()


def steps(touched: DataFrame, a: str, b: str, max_hops: int = MAX_HOPS) -> DataFrame:
    """step, kind, id of the shortest path; no row without one."""
    found = shortest(touched, a, b, max_hops) or []
    rows = [(i, "File" if i % 2 else "Author", x) for i, x in enumerate(found)]
    return touched.sparkSession.createDataFrame(rows, "step int, kind string, id string")
