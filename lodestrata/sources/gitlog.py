"""Version-control history as tables: log text, HEAD listings, and the clone and log commands that make them.

The log text holds a block for each commit, begun by a record separator: hash, author name, author e-mail, ISO date and
subject with unit separators between, a line end, then numstat fields that end in NUL. Parsing is one regular expression
for a file's entry, so that it stays in the JVM and splits anywhere between blocks.
"""

from __future__ import annotations

import shutil
import subprocess
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension_of, module_of, shortened

#: Fixed values of the log format.
RECORD, UNIT = "\x1e", "\x1f"
PRETTY = "%x1e%H%x1f%aN%x1f%aE%x1f%aI%x1f%s"
#: additions, deletions, then a path, or nothing and the old and the new path of a rename.
ENTRY = r"(\d+|-)\t(\d+|-)\t(?:([^\x00]+)\x00|\x00([^\x00]+)\x00([^\x00]+)(?:\x00|$))"
#: Fixed value: characters of a message that are kept.
MESSAGE_LENGTH = 500


class GitError(RuntimeError):
    pass


def _git(*args: str, timeout: int) -> str:
    try:
        done = subprocess.run(["git", *args], capture_output=True, timeout=timeout, check=True)
    except (subprocess.SubprocessError, OSError) as e:
        raise GitError(f"git {args[0]}: {e}") from e
    return done.stdout.decode("utf-8", "replace")


def clone(url: str, to: str, depth: int | None = None, timeout: int = 300) -> str:
    """Clones url into the folder to, which is emptied first."""
    shutil.rmtree(to, ignore_errors=True)
    _git("clone", *(["--depth", str(depth)] if depth else []), "--", url, to, timeout=timeout)
    return to


def log_text(repo: str, max_commits: int = 5000, timeout: int = 300) -> str:
    return _git("-C", repo, "log", f"-n{max_commits}", "--no-merges", "-M", "-z", "--numstat", f"--pretty=format:{PRETTY}", timeout=timeout)


def head_paths(spark: SparkSession, repo: str, timeout: int = 60) -> DataFrame:
    """path of every file at HEAD; names are taken as they are."""
    names = _git("-C", repo, "ls-tree", "-r", "-z", "--name-only", "HEAD", timeout=timeout).split("\0")
    return spark.createDataFrame([(n,) for n in names if n], "path string")


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """log_pos, block of log text in files under path; log_pos rises within a file, in any split, and from file to file."""
    rows = spark.read.option("lineSep", RECORD).text(path)
    files = sorted(r.file for r in rows.select(F.col("_metadata.file_path").alias("file")).distinct().collect())  # names of files
    numbers = spark.createDataFrame([(n, i << 44) for i, n in enumerate(files)], "file string, base long")
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = rows.select(F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") + within).alias("at"), "value")
    return placed.join(F.broadcast(numbers), "file").select((F.col("base") + F.col("at")).alias("log_pos"), F.col("value").alias("block"))


def blocks(spark: SparkSession, text: str) -> DataFrame:
    """The same for a text at hand."""
    return spark.createDataFrame(list(enumerate(text.split(RECORD))), "log_pos long, block string")


def _entry(hit: Column) -> Column:
    part = lambda k: F.regexp_extract(hit, ENTRY, k)
    number = lambda k: F.when(part(k) == "-", 0).otherwise(part(k).try_cast("long")).cast("long")
    renamed = part(5) != ""
    return F.struct(
        F.when(renamed, part(5)).otherwise(part(3)).alias("path"),
        number(1).alias("additions"),
        number(2).alias("deletions"),
        F.when(renamed, "R").otherwise("M").alias("change_type"),
        F.when(renamed, part(4)).alias("old_path"),
    )


def parse_numstat(body: Column) -> Column:
    """array<struct<path,additions,deletions,change_type,old_path>> of numstat fields; a cut-off last entry is left out."""
    return F.transform(F.regexp_extract_all(body, F.lit(ENTRY), F.lit(0)), _entry)


def parse_log(rows: DataFrame) -> DataFrame:
    """Commits with their files, of blocks (log_pos, block). Commits without files are dropped; an author without an
    e-mail gets one of the name."""
    head, body = F.substring_index("block", "\n", 1), F.expr("substring(block, instr(block, '\n') + 1)")
    rows = rows.where(F.col("block").contains(UNIT)).select("log_pos", F.split(head, UNIT, 5).alias("h"), "block", body.alias("body"))
    name, email = F.get("h", F.lit(1)), F.trim(F.get("h", F.lit(2)))
    # the subject ends at a NUL where the log is separated by NULs
    out = rows.select(
        "log_pos",
        F.get("h", F.lit(0)).alias("hash"),
        name.alias("author_name"),
        F.when(email == "", F.concat(name, F.lit("@unknown.local"))).otherwise(email).alias("author_email"),
        F.get("h", F.lit(3)).alias("timestamp"),
        F.substring_index(F.get("h", F.lit(4)), "\0", 1).alias("message"),
        parse_numstat(F.col("body")).alias("files"),
    )
    return out.where(F.size("files") > 0)


def tables(commits: DataFrame, module_depth: int = 1) -> dict[str, DataFrame]:
    """author, commit, file, modified and renamed_to of parsed commits.

    An author's name is that of the oldest commit; files_changed counts entries before the fold to one row per commit and
    path, of which the last entry wins; files are all paths and all that were renamed.
    """
    entry = commits.select("hash", "log_pos", F.posexplode("files").alias("pos", "f")).select("hash", "log_pos", "pos", "f.*")
    total = lambda c: F.aggregate("files", F.lit(0).cast("long"), lambda n, f: n + f[c])
    once = commits.withColumn("rank", F.col("log_pos"))
    commit = once.groupBy("hash").agg(
        *[F.min_by(c, "rank").alias(c) for c in ("author_email", "timestamp", "log_pos")],
        F.min_by(F.substring("message", 1, MESSAGE_LENGTH), "rank").alias("message"),
        F.min_by(total("additions"), "rank").alias("additions"),
        F.min_by(total("deletions"), "rank").alias("deletions"),
        F.min_by(F.size("files").cast("long"), "rank").alias("files_changed"),
    )
    author = commits.groupBy(F.col("author_email").alias("email")).agg(F.max_by("author_name", "log_pos").alias("name"))
    modified = entry.groupBy("hash", "path").agg(
        *[F.max_by(c, "pos").alias(c) for c in ("additions", "deletions", "change_type")]
    )
    renamed = entry.where("old_path is not null").select("old_path", F.col("path").alias("new_path")).distinct()
    # in one pass: each entry has its path and, if it was renamed, the old one
    own = F.struct("path", F.col("old_path").isNotNull().alias("renamed"))
    old = F.struct(F.col("old_path").alias("path"), F.lit(False).alias("renamed"))
    names = entry.select(F.inline(F.when(F.col("old_path").isNull(), F.array(own)).otherwise(F.array(own, old))))
    file = names.groupBy("path").agg(F.bool_or("renamed").alias("has_rename_history")).select(
        "path", extension_of(F.col("path")).alias("extension"), module_of(F.col("path"), module_depth).alias("module"),
        F.lit(False).alias("is_deleted"), "has_rename_history",
    )
    commit = commit.withColumn("ts", F.to_timestamp("timestamp"))
    return {"author": author, "commit": commit, "file": file, "modified": modified, "renamed_to": renamed}


def load_records(commits: DataFrame) -> DataFrame:
    """Commits as records for another store: totals, the shortened message and the files."""
    total = lambda c: F.aggregate("files", F.lit(0).cast("long"), lambda n, f: n + f[c])
    return commits.select(
        "hash", "author_name", "author_email", "timestamp", shortened(F.col("message"), MESSAGE_LENGTH).alias("message"),
        total("additions").alias("additions"), total("deletions").alias("deletions"), "files",
    )


def write_log(repo: str, to: str, max_commits: int = 5000) -> str:
    """The log text of a repository as a file that read_blocks can read."""
    Path(to).write_text(log_text(repo, max_commits))
    return to
