"""Which function a call means, and which file an import means: joins against names that have exactly one candidate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def module_index(files: DataFrame) -> DataFrame:
    """module, target: every dotted ending of a file's module name that only one file of files (path) has."""
    dotted = F.regexp_replace(F.regexp_replace("path", r"(^|/)__init__\.py$", ""), r"\.py$", "")
    parts = F.split(dotted, "/")
    endings = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, 1_000_000), "."))
    rows = files.where(F.col("path") != "__init__.py").select("path", F.explode(endings).alias("module"))
    return rows.groupBy("module").agg(F.min("path").alias("target"), F.countDistinct("path").alias("n")).where("n = 1").drop("n")


def _folder(level: Column) -> Column:
    """The folder that a relative import of this level starts from."""
    parts = F.split("path", "/")
    left = F.size(parts) - level
    return F.when(left > 0, F.array_join(F.slice(parts, F.lit(1), F.greatest(left, F.lit(0))), "/")).when(left == 0, F.lit(""))


def resolve_imports(bindings: DataFrame, files: DataFrame) -> DataFrame:
    """bindings (path, local, module, name, level, pos) with target, the file that each means; null where none or several.

    Absolute names go by module_index; `from package import module` means the module if there is one, as long as the
    package itself is found. Relative ones look from their folder for module.py, then module/__init__.py; without a
    module for the named submodule, then for the folder's own __init__.py.
    """
    whole = F.concat_ws(".", "module", "name")
    folder = _folder(F.col("level"))
    inside = F.regexp_replace(F.coalesce("module", F.lit("")), r"\.", "/")
    trimmed = lambda c: F.regexp_replace(c, "^/+|/+$", "")
    stem, sub = trimmed(F.concat_ws("/", folder, inside)), trimmed(F.concat_ws("/", folder, "name"))
    file_at = lambda c: trimmed(F.concat(c, F.lit("/__init__.py")))

    def attempt(rank: int, kind: str, value: Column) -> Column:
        return F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), value.alias("value"))

    absolute = F.array(attempt(0, "module", F.when(F.col("name").isNotNull(), whole)), attempt(1, "module", F.col("module")))
    named = F.array(attempt(2, "file", F.concat(stem, F.lit(".py"))), attempt(3, "file", file_at(stem)))
    bare = F.array(attempt(2, "file", F.concat(sub, F.lit(".py"))), attempt(3, "file", file_at(stem)))
    tries = F.when(F.col("level") == 0, absolute).when(folder.isNotNull(), F.when(F.col("module").isNull(), bare).otherwise(named))
    each = bindings.select("path", "pos", F.explode(tries).alias("t")).where("t.value is not null").select("path", "pos", "t.*")
    index = module_index(files).select(F.lit("module").alias("kind"), F.col("module").alias("value"), "target")
    known = index.union(files.select(F.lit("file"), "path", "path").distinct())
    best = each.join(known.hint("merge"), ["kind", "value"]).groupBy("path", "pos").agg(F.min_by("target", "rank").alias("target"), F.max("rank").alias("last"))
    return bindings.join(best.where("last > 0").drop("last").hint("merge"), ["path", "pos"], "left")


def import_edges(resolved: DataFrame) -> DataFrame:
    """from_path, to_path, imported_names of resolved imports between different files."""
    edges = resolved.where("target is not null and target <> path")
    name = F.coalesce("name", "module")
    return edges.groupBy(F.col("path").alias("from_path"), F.col("target").alias("to_path")).agg(F.array_sort(F.collect_set(name)).alias("imported_names"))


def resolve_calls(sites: DataFrame, functions: DataFrame, resolved: DataFrame) -> DataFrame:
    """caller_id, callee_id, confidence, resolution, line, pos of the sites that mean exactly one function.

    A name or self.name means the file's own function of that name; a name or base.name that was imported means that
    function in the imported file; else the repository's only function of that name, with low confidence. Names that
    several functions have are not used; nor are calls of a function by itself.

    No side is broadcast, as all grow with the repository and a plan guesses them from compressed files. Sites that look
    for nothing in a join get a key of their own file's, so that they do not meet in one task.
    """
    unique = lambda df, *keys: df.groupBy(*keys).agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").drop("n")
    own = unique(functions.select("path", "name", "id"), "path", "name")
    all_ = unique(functions.select("name", "id"), "name").withColumnRenamed("id", "any_id")
    bound = resolved.where("target is not null").groupBy("path", "local").agg(F.max_by("target", "pos").alias("target"))
    local = F.when(F.col("kind") == "name", F.col("name")).when(F.col("kind") == "name_attr", F.col("base"))
    rows = sites.withColumn("local", local).join(own.withColumnRenamed("id", "own_id").hint("merge"), ["path", "name"], "left")
    own_id = F.when(F.col("kind") != "name_attr", F.col("own_id"))
    nothing = F.concat(F.lit("\0"), "path")  # no path, and no name
    rows = rows.join(bound.hint("merge"), ["path", "local"], "left").withColumn("target", F.when(own_id.isNull() & F.col("target").isNotNull(), F.col("target")).otherwise(nothing))
    there = own.select(F.col("path").alias("target"), "name", F.col("id").alias("there_id"))
    rows = rows.join(there.hint("merge"), ["target", "name"], "left")
    rows = rows.withColumn("name", F.when(own_id.isNull() & F.col("there_id").isNull(), F.col("name")).otherwise(nothing)).join(all_.hint("merge"), "name", "left")
    callee = F.coalesce(own_id, "there_id", "any_id")
    how = F.when(own_id.isNotNull(), "same_file").when(F.col("there_id").isNotNull(), "import_resolved").otherwise("name_heuristic")
    out = rows.select("caller_id", callee.alias("callee_id"), F.when(how == "name_heuristic", "low").otherwise("high").alias("confidence"), how.alias("resolution"), "line", "pos")
    return out.where("callee_id is not null and callee_id <> caller_id")
