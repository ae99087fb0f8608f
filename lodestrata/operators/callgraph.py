"""Functions and the calls between them."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import contains_ci
from ..runtime import written

if TYPE_CHECKING:
    from ..plans.graph import RepoGraph

BRIEF = ("id", "name", "qualname", "path", "language")
COLUMNS = (*BRIEF, "start_line", "end_line", "is_exported", "is_method")


def strict_calls(g: RepoGraph) -> DataFrame:
    """Calls whose ends are both known functions; calls in class bodies have a caller that is none."""
    ids = g.function.select("id")
    ends = g.calls.join(ids.withColumnRenamed("id", "caller_id"), "caller_id", "left_semi")
    return ends.join(ids.withColumnRenamed("id", "callee_id"), "callee_id", "left_semi")


def caller_counts(calls: DataFrame) -> DataFrame:
    """callee_id, caller_count: rows for each callee, unknown callers included."""
    return calls.groupBy("callee_id").agg(F.count("*").alias("caller_count"))


def with_counts(g: RepoGraph, functions: DataFrame) -> DataFrame:
    """functions with caller_count and callee_count, change_count and risk_score with zeros for null."""
    calls = strict_calls(g)
    callers = calls.groupBy(F.col("callee_id").alias("id")).agg(F.countDistinct("caller_id").alias("caller_count"))
    callees = calls.groupBy(F.col("caller_id").alias("id")).agg(F.countDistinct("callee_id").alias("callee_count"))
    rows = functions.select(*COLUMNS, "change_count", "risk_score").join(callers, "id", "left").join(callees, "id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("caller_count", "callee_count", "change_count")}
    return rows.withColumns(zero | {"risk_score": F.coalesce("risk_score", F.lit(0.0))})


def file_functions(g: RepoGraph, path: str) -> DataFrame:
    return g.function.where(F.col("path") == path).select(*COLUMNS).orderBy("start_line", "id")


def file_functions_with_counts(g: RepoGraph, path: str) -> DataFrame:
    rows = with_counts(g, g.function.where(F.col("path") == path))
    return rows.orderBy(F.desc("caller_count"), "start_line", "id")


def functions_list(g: RepoGraph, search: str = "", sort: str = "callers", limit: int = 200) -> DataFrame:
    """Functions whose qualified name or path holds search; sort: callers or risk."""
    few = g.function.where(contains_ci(F.col("qualname"), search) | contains_ci(F.col("path"), search))
    by = "risk_score" if sort == "risk" else "caller_count"
    return with_counts(g, few).orderBy(F.desc(by), "qualname", "id").limit(limit)


def map_candidates(g: RepoGraph, limit: int = 60) -> DataFrame:
    """The most called functions, with weight: callers against the most callers."""
    counts = strict_calls(g).groupBy(F.col("callee_id").alias("id")).agg(F.countDistinct("caller_id").alias("caller_count"))
    few = counts.orderBy(F.desc("caller_count"), "id").limit(limit)
    most = few.agg(F.max("caller_count").alias("most"))
    rows = few.crossJoin(F.broadcast(most)).join(g.function.select(*BRIEF), "id")  # one row
    return rows.select(*BRIEF, "caller_count", F.round(F.col("caller_count") / F.col("most"), 3).alias("weight"))


def map_edges(g: RepoGraph, functions: DataFrame, limit: int = 150) -> DataFrame:
    """source, target, confidence, call_count of calls among functions (id)."""
    ids = functions.select("id").distinct()
    calls = g.calls.join(ids.withColumnRenamed("id", "caller_id"), "caller_id", "left_semi")
    calls = calls.join(ids.withColumnRenamed("id", "callee_id"), "callee_id", "left_semi")
    rows = calls.select(F.col("caller_id").alias("source"), F.col("callee_id").alias("target"), "confidence", "call_count")
    return rows.orderBy(F.desc("call_count"), "source", "target").limit(limit)


def function_detail(g: RepoGraph, function_id: str) -> DataFrame:
    return g.function.where(F.col("id") == function_id).select(*COLUMNS, "source")


def neighbours(g: RepoGraph, function_id: str, direction: str, limit: int | None = None) -> DataFrame:
    """Callers or callees of a function, most calls first; without a limit all of them."""
    here, there = ("callee_id", "caller_id") if direction == "callers" else ("caller_id", "callee_id")
    near = g.calls.where(F.col(here) == function_id).select(F.col(there).alias("id"), "confidence", "call_count")
    known = g.function.where(F.col("id") == function_id).select(F.lit(True).alias("_known"))
    rows = near.join(g.function.select(*BRIEF), "id").crossJoin(F.broadcast(known)).select(*BRIEF, "confidence", "call_count")
    rows = rows.orderBy(F.desc("call_count"), "id")
    return rows if limit is None else rows.limit(limit)


def second_neighbours(g: RepoGraph, function_id: str, direction: str, limit: int = 24) -> DataFrame:
    """via and what it calls (or what calls it), for each direct neighbour via; neither the function nor via itself."""
    here, there = ("callee_id", "caller_id") if direction == "callers" else ("caller_id", "callee_id")
    calls = strict_calls(g)
    via = calls.where(F.col(here) == function_id).select(F.col(there).alias("via")).distinct()
    step = calls.select(F.col(here).alias("via"), F.col(there).alias("id"), "confidence", "call_count")
    rows = step.join(via, "via", "left_semi").where((F.col("id") != function_id) & (F.col("id") != F.col("via")))
    rows = rows.join(g.function.select(*BRIEF), "id").select("via", *BRIEF, "confidence", "call_count")
    return rows.orderBy(F.desc("call_count"), "via", "id").limit(limit)


def file_call_graph(g: RepoGraph, path: str) -> DataFrame:
    """Every call whose caller is in the file, with the callee's description."""
    own = g.function.where(F.col("path") == path).select(F.col("id").alias("caller_id"))
    callee = g.function.select(F.col("id").alias("callee_id"), *[F.col(c).alias(f"target_{c}") for c in ("path", "name", "qualname", "language")])
    rows = g.calls.join(own, "caller_id").join(callee, "callee_id")
    weight = F.greatest(F.lit(1), F.coalesce("call_count", F.lit(1)))
    return rows.select(
        F.col("caller_id").alias("source"), F.col("callee_id").alias("target"), "target_path", "target_name", "target_qualname",
        "target_language", F.coalesce("confidence", F.lit("high")).alias("confidence"), weight.alias("call_count"),
    )


def file_call_nodes(g: RepoGraph, path: str) -> DataFrame:
    """id, path, name, hop, weight: the file's functions, and once each what they call elsewhere."""
    own = g.function.where(F.col("path") == path).select("id", "path", "name", F.lit(1).alias("hop"), F.lit(1.0).alias("weight"))
    out = file_call_graph(g, path).select(F.col("target").alias("id"), F.col("target_path").alias("path"), F.col("target_name").alias("name"))
    away = out.where(F.col("path") != path).distinct().select("id", "path", "name", F.lit(2).alias("hop"), F.lit(0.6).alias("weight"))
    return own.unionByName(away)


#: Fixed value: lines of call sites that a pair keeps.
CALL_LINES = 20


def dedupe_calls(sites: DataFrame) -> DataFrame:
    """One row per pair of call sites (caller_id, callee_id, confidence, resolution, line, pos).

    call_count counts sites; call_lines are the first 20 by pos; any high site makes the pair high, and resolution is
    that of the first high site, else of the first site.
    """
    sites, pair = written(sites, "call-sites"), ("caller_id", "callee_id")
    high = F.col("confidence") == "high"
    totals = sites.groupBy(*pair).agg(
        F.when(F.bool_or(high), "high").otherwise("low").alias("confidence"),
        F.min_by("resolution", F.struct(F.when(high, 0).otherwise(1), F.col("pos"))).alias("resolution"),
        F.count("*").alias("call_count"),
    )
    # a limit on ranks, which tasks apply to what they have before they send it: a pair's list never has more lines
    rank = F.row_number().over(Window.partitionBy(*pair).orderBy("pos", "line"))
    first = sites.select(*pair, "pos", "line", rank.alias("rank")).where(F.col("rank") <= CALL_LINES)
    lines = first.groupBy(*pair).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("call_lines"))
    return totals.join(lines, list(pair))


def dedupe_imports(imports: DataFrame) -> DataFrame:
    """One row per pair of files with the sorted union of the imported names."""
    names = imports.select("from_path", "to_path", F.explode_outer("imported_names").alias("name"))
    return names.groupBy("from_path", "to_path").agg(F.array_sort(F.collect_set("name")).alias("imported_names"))
