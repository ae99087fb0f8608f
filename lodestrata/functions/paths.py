"""Column functions on file paths and commit messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a commit message that fixes something says.
FIX_PATTERNS = (r"\bfix(?:es|ed)?\b", r"\bbug\b", r"#\d+", r"^fix(?:\([^)]*\))?:")


def extension_of(path: Column) -> Column:
    """The lower-case extension without its dot; empty for none, and for names that only start with a dot."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(F.regexp_extract(name, r"^\.*[^.].*\.([^.]*)$", 1))


def module_of(path: Column, depth: int = 1) -> Column:
    """The first depth segments, `root` for a file at the top."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) == 1, F.lit("root")).otherwise(F.array_join(F.slice(parts, 1, depth), "/"))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def is_bug_fix(message: Column) -> Column:
    found = F.lit(False)
    for pattern in FIX_PATTERNS:
        found = found | message.rlike(f"(?i){pattern}")
    return F.coalesce(found, F.lit(False))


def shortened(text: Column, most: int, mark: str = "") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(mark))).otherwise(text)
