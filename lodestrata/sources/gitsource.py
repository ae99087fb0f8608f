"""A repository's history as Spark data sources, which executors read in ranges of commits: nothing of the log passes the driver.

    register(spark)
    spark.read.format("git_log").option("path", repo).load()        # log_pos, block: what gitlog.parse_log takes
    spark.readStream.format("git_log").option("path", repo).load()  # commits that are new since the checkpoint
    spark.read.format("git_tree").option("path", repo).load()       # path of every file at HEAD

The driver asks for HEAD's hash and for the number of commits, or the names at the top of the tree; a partition is a range of the
log from that hash, or a folder. The repository has to be where all executors see it.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from ..runtime import ship
from .gitlog import PRETTY, RECORD, GitError

#: Commits of a partition, unless the option commitsPerPartition says otherwise.
COMMITS = 2000
LOG = "log_pos bigint, block string"


def git(repo: str, *args: str, timeout: int = 300) -> str:
    try:
        return subprocess.run(["git", "-C", repo, *args], capture_output=True, timeout=timeout, check=True).stdout.decode("utf-8", "replace")
    except (subprocess.SubprocessError, OSError) as e:
        raise GitError(f"git {args[0]}: {e}") from e


@dataclass
class Range(InputPartition):
    """count commits of a revision range after the first skip ones, of which the first has position at."""

    revisions: str
    skip: int
    count: int
    at: int


def ranges(repo: str, revisions: str, first: int, end: int | None, size: int) -> list[Range]:
    """The commits at the positions from first up to end of a revision range, newest first, cut into partitions."""
    n = int(git(repo, "rev-list", "--count", "--no-merges", *revisions.split()).strip() or 0)
    end = n if end is None else min(end, n)
    return [Range(revisions, a, min(size, end - a), a) for a in range(first, end, size)] or [Range("", 0, 0, 0)]


def read_range(repo: str, part: Range) -> Iterator[tuple[int, str]]:
    """log_pos, block of a partition, as git writes them: no more than a block is held."""
    if not part.count:
        return
    command = ["git", "-C", repo, "log", f"--skip={part.skip}", f"--max-count={part.count}", "--no-merges", "-M", "-z", "--numstat",
               f"--pretty=format:{PRETTY}", *part.revisions.split()]
    with subprocess.Popen(command, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as log:
        rest, at = b"", part.at
        while chunk := log.stdout.read(1 << 20):
            *whole, rest = (rest + chunk).split(RECORD.encode())
            for block in whole:
                if block:
                    yield at, block.decode("utf-8", "replace")
                    at += 1
        if rest:
            yield at, rest.decode("utf-8", "replace")
        error = log.stderr.read().decode("utf-8", "replace")
    if log.returncode:
        raise GitError(f"git log: {error}")


class LogReader(DataSourceReader):
    """Filters on log_pos narrow the range that is read; they are checked by Spark as well."""

    def __init__(self, options: dict):
        self.repo, self.size = options["path"], int(options.get("commitsPerPartition", COMMITS))
        self.first, self.end = 0, int(options["maxCommits"]) if "maxCommits" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            low = {EqualTo: 0, GreaterThanOrEqual: 0, GreaterThan: 1}.get(type(f))
            high = {EqualTo: 1, LessThanOrEqual: 1, LessThan: 0}.get(type(f))
            if getattr(f, "attribute", None) == ("log_pos",):
                if low is not None:
                    self.first = max(self.first, f.value + low)
                if high is not None:
                    self.end = f.value + high if self.end is None else min(self.end, f.value + high)
            yield f

    def partitions(self) -> list[Range]:
        head = git(self.repo, "rev-parse", "HEAD").strip()
        return ranges(self.repo, head, self.first, self.end, self.size)

    def read(self, partition: Range) -> Iterator[tuple[int, str]]:
        return read_range(self.repo, partition)


class LogStream(DataSourceStreamReader):
    """Offsets are hashes of HEAD: a batch has the commits that one reaches and the one before does not."""

    def __init__(self, options: dict):
        self.repo, self.size = options["path"], int(options.get("commitsPerPartition", COMMITS))

    def initialOffset(self) -> dict:
        return {"head": ""}

    def latestOffset(self) -> dict:
        return {"head": git(self.repo, "rev-parse", "HEAD").strip()}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return ranges(self.repo, f"{end['head']} ^{start['head']}" if start["head"] else end["head"], 0, None, self.size)

    def read(self, partition: Range) -> Iterator[tuple[int, str]]:
        return read_range(self.repo, partition)

    def commit(self, end: dict) -> None:
        pass


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return LOG

    def reader(self, schema) -> LogReader:
        return LogReader(self.options)

    def streamReader(self, schema) -> LogStream:
        return LogStream(self.options)


@dataclass
class Folder(InputPartition):
    head: str
    name: str
    is_file: bool


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo = options["path"]

    def partitions(self) -> list[Folder]:
        head = git(self.repo, "rev-parse", "HEAD").strip()
        entries = [e.split("\t", 1) for e in git(self.repo, "ls-tree", "-z", head).split("\0") if e]
        return [Folder(head, name, kind.split()[1] != "tree") for kind, name in entries] or [Folder(head, "", True)]

    def read(self, partition: Folder) -> Iterator[tuple[str]]:
        if partition.is_file:
            yield from [(partition.name,)] if partition.name else []
            return
        for path in git(self.repo, "ls-tree", "-r", "-z", "--name-only", f"{partition.head}:{partition.name}").split("\0"):
            if path:
                yield (f"{partition.name}/{path}",)


class GitTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_tree"

    def schema(self) -> str:
        return "path string"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GitLog)
    spark.dataSource.register(GitTree)
