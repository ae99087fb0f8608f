"""The columnar encoding of a repository: a history graph and a function graph as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lineage

#: Column types of each table; a table may have more columns.
SCHEMAS = {
    "author": "email string, name string",
    "commit": "hash string, author_email string, message string, timestamp string, ts timestamp, additions long, "
    "deletions long, files_changed long",
    "file": "path string, extension string, module string, is_deleted boolean, has_rename_history boolean",
    "modified": "hash string, path string, additions long, deletions long, change_type string",
    "renamed_to": "old_path string, new_path string",
    "function": "id string, path string, name string, qualname string, language string, start_line int, end_line int, "
    "is_exported boolean, is_method boolean, source string, complexity int, change_count long, risk_score double",
    "calls": "caller_id string, callee_id string, confidence string, resolution string, call_count long, call_lines array<int>",
    "imports": "from_path string, to_path string, imported_names array<string>",
    "unread": "path string, reason string",
}
KEYS = {
    "author": ["email"], "commit": ["hash"], "file": ["path"], "modified": ["hash", "path"], "renamed_to": ["old_path", "new_path"],
    "function": ["id"], "calls": ["caller_id", "callee_id"], "imports": ["from_path", "to_path"],
}


@dataclass(frozen=True)
class Settings:
    """Defaults that are part of the results."""

    min_commits: int = 8
    max_files_per_commit: int = 10
    module_min_count: int = 2
    half_life_days: float = 180.0
    concentration: float = 0.5
    sole_boost: float = 0.5
    sole_baseline: float = 0.1
    stale_days: int = 180
    rename_hops: int = 20
    anchor_files: int = 80


@dataclass
class RepoGraph:
    """One DataFrame for each node label and edge type; derived tables are filled in by plans.materialize."""

    author: DataFrame
    commit: DataFrame
    file: DataFrame
    modified: DataFrame
    renamed_to: DataFrame
    function: DataFrame | None = None
    calls: DataFrame | None = None
    imports: DataFrame | None = None
    hunks: DataFrame | None = None
    unread: DataFrame | None = None
    file_hotspot: DataFrame | None = None
    author_stats: DataFrame | None = None
    author_criticality: DataFrame | None = None
    coupled_with: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)

    @cached_property
    def renames(self) -> DataFrame:
        """Every (src, dst, depth) within the hop limit of the rename edges, at its least depth."""
        edges = self.renamed_to.select(F.col("old_path").alias("src"), F.col("new_path").alias("dst"))
        return lineage.closure(edges, self.settings.rename_hops)

    @property
    def touches(self) -> DataFrame:
        """A row for each file that a commit touched, with what is known of the commit."""
        about = self.commit.select("hash", "author_email", "timestamp", "ts", "files_changed")
        return self.modified.select("hash", "path").join(about, "hash")

    def small_touches(self, max_files: int) -> DataFrame:
        """touches of commits of at most max_files files: the bound on what a self-join by commit can multiply."""
        return self.touches.where(F.col("files_changed") <= max_files)

    @property
    def live_files(self) -> DataFrame:
        return self.file.where(~F.col("is_deleted"))

    def tables(self) -> dict[str, DataFrame]:
        own = {f.name: getattr(self, f.name) for f in fields(self)}
        return {k: v for k, v in own.items() if isinstance(v, DataFrame)}

    def register_views(self, prefix: str = "") -> list[str]:
        """Temporary views of all tables, for Spark SQL."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)
        return [prefix + name for name in self.tables()]

    def validate(self) -> DataFrame:
        """problem, n: repeated keys, and edges without their ends. One row for each problem found."""
        found = []
        for name, keys in KEYS.items():
            df = getattr(self, name)
            if df is not None:
                again = df.groupBy(*keys).count().where("count > 1")
                found.append(again.agg(F.lit(f"repeated key in {name}").alias("problem"), F.count("*").alias("n")))
        ends = [
            ("modified", "hash", "commit", "hash"), ("modified", "path", "file", "path"), ("commit", "author_email", "author", "email"),
            ("calls", "caller_id", "function", "id"), ("calls", "callee_id", "function", "id"),
        ]
        for name, column, other, key in ends:
            a, b = getattr(self, name), getattr(self, other)
            if a is not None and b is not None:
                loose = a.select(F.col(column).alias(key)).join(b.select(key), key, "left_anti")
                found.append(loose.agg(F.lit(f"{name}.{column} without {other}").alias("problem"), F.count("*").alias("n")))
        out = found[0]
        for df in found[1:]:
            out = out.union(df)
        return out.where("n > 0")


def save(g: RepoGraph, path: str) -> None:
    """Each table as Parquet under path, sorted within files by its key so that lookups skip row groups."""
    for name, df in g.tables().items():
        keys = [k for k in KEYS.get(name, df.columns[:1]) if k in df.columns]
        df.sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/{name}")


def load(spark: SparkSession, path: str, settings: Settings | None = None) -> RepoGraph:
    """A graph that save wrote; tables that are absent stay None."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = {s.getPath().getName() for s in fs.listStatus(root)}
    names = [f.name for f in fields(RepoGraph) if f.name in there]
    return RepoGraph(**{n: spark.read.parquet(f"{path}/{n}") for n in names}, settings=settings or Settings())
