"""Function churn and risk, touched functions and pull-request flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_bug_fix
from ..functions.quantiles import quantile
from ..functions.scores import function_risk, spearman, strength
from ..runtime import written
from .callgraph import caller_counts
from .ranges import overlapping


def _overlapping(functions: DataFrame, hunks: DataFrame) -> DataFrame:
    """Functions with the hunks (path, lo, hi and more) that overlap their lines."""
    return overlapping(functions.select("id", "path", "start_line", "end_line"), hunks)


def change_history(functions: DataFrame, hunks: DataFrame) -> DataFrame:
    """id, change_count, bug_fix_count of every function: distinct commits with a hunk (path, hash, message, lo, hi) in
    its lines, and those among them whose message says that they fix something. A commit has one message."""
    fixes = hunks.select("path", "hash", "lo", "hi", is_bug_fix(F.col("message")).cast("int").alias("fix"))
    seen = _overlapping(functions, fixes).groupBy("id", "hash").agg(F.max("fix").alias("fix"))
    counts = seen.groupBy("id").agg(F.count("*").alias("change_count"), F.sum("fix").alias("bug_fix_count"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("change_count", "bug_fix_count")]
    return functions.select("id").join(counts, "id", "left").select("id", *zero)


def with_risk(functions: DataFrame, calls: DataFrame, history: DataFrame) -> DataFrame:
    """functions with change_count, caller_count and risk_score; callers count whether known or not."""
    callers = caller_counts(calls).withColumnRenamed("callee_id", "id")
    kept = [c for c in functions.columns if c not in ("change_count", "risk_score", "caller_count")]
    rows = functions.select(*kept).join(history.select("id", "change_count"), "id", "left").join(callers, "id", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("change_count", "caller_count")})
    return rows.withColumn("risk_score", function_risk(F.col("change_count"), F.col("caller_count"), F.col("complexity")))


def touched_functions(functions: DataFrame, hunks: DataFrame, by: str | None = None) -> DataFrame:
    """The functions with a hunk (path, lo, hi) in their lines, once each; with by, a column of hunks, once for each value."""
    some = _overlapping(functions, hunks.select("path", "lo", "hi", *([by] if by else []))).select("id", *([by] if by else [])).distinct()
    return functions.join(some, "id", "inner" if by else "left_semi")


def risk_percentile(functions: DataFrame, percentile: float = 90.0) -> DataFrame:
    """threshold: the interpolated percentile of the scores above 0; 0 if there are none."""
    found = quantile(functions.where("risk_score > 0"), "risk_score", percentile / 100.0)
    return functions.sparkSession.createDataFrame([(found or 0.0,)], "threshold double")


def flagged(functions: DataFrame, hunks: DataFrame, percentile: float = 90.0, min_callers: int = 5, by: str | None = None) -> DataFrame:
    """Touched functions (with caller_count) that are riskier than the percentile or have many callers, riskiest first;
    with by, for each value of that column of hunks (a set of changes)."""
    functions = written(functions, "scored-functions")  # read for the percentile, the lines and the flags
    threshold = F.broadcast(risk_percentile(functions, percentile))  # one row
    rows = touched_functions(functions, hunks, by).crossJoin(threshold)
    risky = (F.col("risk_score") > 0) & (F.col("risk_score") >= F.col("threshold"))
    return rows.where(risky | (F.col("caller_count") >= min_callers)).orderBy(F.desc("risk_score"), "id")


def markdown(flags: DataFrame) -> str | None:
    """A table of all flagged functions of one set of changes, for a comment; None without any."""
    line = F.format_string("| `%s` | %s | %.4f | %d |", F.col("qualname"), F.col("path"), F.col("risk_score"), F.col("caller_count"))
    lines = [r.line for r in flags.select(line.alias("line")).toLocalIterator()]
    head = ["| Function | File | Risk | Callers |", "| --- | --- | ---: | ---: |"]
    return "\n".join([*head, *lines]) + "\n" if lines else None


def validate_risk(functions: DataFrame, history: DataFrame) -> DataFrame:
    """n, rho, strength: rank correlation of risk scores with bug-fix counts."""
    rows = functions.select("id", "risk_score").join(history.select("id", "bug_fix_count"), "id")
    return spearman(rows, "risk_score", "bug_fix_count").withColumn("strength", strength(F.col("rho")))
