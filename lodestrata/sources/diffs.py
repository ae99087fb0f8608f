"""Changed line ranges of patches: per-file logs and diffs of several files."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import batched, ship

#: Fixed values of the patch format: a hunk's header, on its own and with both counts.
HUNK = r"(?m)^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
COUNTS = r"@@ -\d+(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def hunk_ranges(patch: Column) -> Column:
    """array<struct<lo,hi>> of the new side of each hunk; a pure deletion touches the line before it."""

    def span(hit: Column) -> Column:
        first, count = F.regexp_extract(hit, HUNK, 1).cast("int"), F.regexp_extract(hit, HUNK, 2)
        lines = F.when(count == "", 1).otherwise(count.try_cast("int"))
        return F.struct(first.alias("lo"), (first + F.greatest(lines, F.lit(1)) - 1).alias("hi"))

    return F.transform(F.regexp_extract_all(patch, F.lit(HUNK), F.lit(0)), span)


def file_hunks(patches: DataFrame) -> DataFrame:
    """path, commit_idx, message, lo, hi of patch logs (path, log): blocks begun by \\x01 and a subject line."""
    each = patches.select("path", F.posexplode(F.split("log", "\x01")).alias("commit_idx", "block")).where(F.col("block") != "")
    message, patch = F.substring_index("block", "\n", 1), F.expr("substring(block, instr(block, '\n') + 1)")
    return each.select("path", "commit_idx", message.alias("message"), F.inline(hunk_ranges(patch)))


def _file_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """path, lo, hi of each hunk of a diff. Lines inside of a hunk are passed over by its counts, whatever they look like; a
    line that can't be in it ends a hunk that is cut short."""
    path, old, new = None, 0, 0
    for line in text.split("\n"):
        mark = line[:1] or " "
        if mark == "\\":  # no line end at the file's end
            continue
        if (old or new) and (old and mark in "- " or new and mark in "+ "):
            old, new = max(0, old - (mark != "+")), max(0, new - (mark != "-"))
            continue
        old = new = 0
        if line.startswith("+++ "):
            name = line[4:].split("\t")[0].rstrip()
            path = name[2:] if name.startswith("b/") else None
        elif (hunk := re.match(COUNTS, line)) and path is not None:
            old, new = (1 if hunk[k] is None else int(hunk[k]) for k in (1, 3))
            yield path, int(hunk[2]), int(hunk[2]) + max(new, 1) - 1


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """path, lo, hi of diffs (text) of several files; deleted files, and headers of none, have none.

    What a line means depends on the counts of the hunk before it, so texts are read line by line, in Arrow batches.
    """
    ship(diffs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = (span for batch in batches for text in batch.column(0) for span in _file_spans(text.as_py() or ""))
        return batched(spans, pa.schema([("path", pa.string()), ("lo", pa.int32()), ("hi", pa.int32())]))

    return diffs.select("text").mapInArrow(read, "path string, lo int, hi int")


def patch_logs(spark: SparkSession, repo: str, paths: DataFrame, timeout: int = 120) -> DataFrame:
    """path, log of the whole history of each path (path), without following renames; a path that fails has an empty log
    and a reason, which is null otherwise.

    Each task asks for its own paths: the repository has to be where all executors see it.
    """
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                command = ["git", "-C", repo, "log", "--no-merges", "-p", "--unified=0", "--format=%x01%s", "--", path]
                log, reason = "", None
                try:
                    log = subprocess.run(command, capture_output=True, timeout=timeout, check=True).stdout.decode("utf-8", "replace")
                except subprocess.TimeoutExpired:
                    reason = f"no history: more than {timeout} seconds"
                except (subprocess.SubprocessError, OSError) as e:
                    reason = f"no history: {type(e).__name__}"
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.string()) for c in (path, log, reason)], ["path", "log", "reason"])

    return paths.select("path").distinct().mapInArrow(read, "path string, log string, reason string")
