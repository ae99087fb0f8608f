"""A repository made of order tables: commits are orders, files are parts, functions are parts modulo 200.

TABLES are SQL that both Spark and DuckDB run, so that the same graph is at hand on either side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import RepoGraph, Settings

AS_OF = "2001-08-02 00:00:00"
BASE = ("nation", "customer", "part", "orders", "lineitem")

TABLES = {
    "author": "SELECT 'n' || CAST(n_nationkey AS STRING) AS email, n_name AS name FROM {nation}",
    "commit": """
SELECT CAST(o.o_orderkey AS STRING) AS hash, 'n' || CAST(c.c_nationkey AS STRING) AS author_email,
  CASE WHEN o.o_orderkey % 7 = 0 THEN 'fix: ' WHEN o.o_orderkey % 11 = 0 THEN 'bug #1 ' ELSE 'feat: ' END || o.o_orderpriority AS message,
  CAST(o.o_orderdate AS STRING) AS timestamp, CAST(o.o_orderdate AS TIMESTAMP) AS ts, l.additions, l.deletions, l.files_changed
FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey JOIN (
  SELECT l_orderkey, CAST(count(*) AS BIGINT) AS files_changed, CAST(sum(l_quantity) AS BIGINT) AS additions,
    CAST(sum(l_linenumber) AS BIGINT) AS deletions FROM {lineitem} GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey""",
    "file": """
SELECT p_brand || '/' || CAST(p_partkey AS STRING) AS path, lower(p_type) AS extension, p_brand AS module,
  p_partkey % 17 = 0 AS is_deleted, (p_partkey - 1) % 20 IN (0, 1) AND p_partkey > 1 AS has_rename_history FROM {part}""",
    "modified": """
SELECT CAST(l_orderkey AS STRING) AS hash, p_brand || '/' || CAST(p_partkey AS STRING) AS path,
  CAST(sum(l_quantity) AS BIGINT) AS additions, CAST(sum(l_linenumber) AS BIGINT) AS deletions, 'M' AS change_type
FROM {lineitem} JOIN {part} ON p_partkey = l_partkey GROUP BY l_orderkey, p_brand, p_partkey""",
    "renamed_to": """
SELECT a.p_brand || '/' || CAST(a.p_partkey AS STRING) AS old_path, b.p_brand || '/' || CAST(b.p_partkey AS STRING) AS new_path
FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_partkey % 20 IN (0, 1) AND a.p_partkey > 0""",
    "function": """
SELECT 'f' || CAST(k % 20 AS STRING) || '::fn' || CAST(k AS STRING) AS id, 'f' || CAST(k % 20 AS STRING) AS path, 'fn' || CAST(k AS STRING) AS name,
  'Mod.fn' || CAST(k AS STRING) AS qualname, 'python' AS language, 10 * CAST(floor(k / 20) AS INT) AS start_line,
  10 * CAST(floor(k / 20) AS INT) + 9 AS end_line, k % 3 <> 0 AS is_exported, k % 5 = 0 AS is_method, 'def fn' || CAST(k AS STRING) AS source, complexity
FROM (SELECT p_partkey % 200 AS k, CAST(1 + max(p_size) % 10 AS INT) AS complexity FROM {part} GROUP BY p_partkey % 200) x""",
    "calls": """
SELECT 'f' || CAST(a % 20 AS STRING) || '::fn' || CAST(a AS STRING) AS caller_id, 'f' || CAST(b % 20 AS STRING) || '::fn' || CAST(b AS STRING) AS callee_id,
  CASE WHEN (a + b) % 3 <> 0 THEN 'high' ELSE 'low' END AS confidence,
  CASE WHEN (a + b) % 3 = 0 THEN 'name_heuristic' WHEN a % 20 = b % 20 THEN 'same_file' ELSE 'import_resolved' END AS resolution,
  CAST(count(*) AS BIGINT) AS call_count
FROM (SELECT l_partkey % 200 AS a, lead(l_partkey % 200) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM {lineitem}) s
WHERE b IS NOT NULL AND a <> b GROUP BY a, b""",
    "hunks": """
SELECT 'f' || CAST(l_partkey % 20 AS STRING) AS path, CAST(l_orderkey AS STRING) AS hash, 10 * l_linenumber AS lo,
  10 * l_linenumber + CAST(l_quantity AS INT) AS hi,
  CASE WHEN l_orderkey % 7 = 0 THEN 'fix: ' WHEN l_orderkey % 11 = 0 THEN 'bug #1 ' ELSE 'feat: ' END AS message FROM {lineitem}""",
}


#: Instead, where some files have one author: each author has an own copy of every tenth part's file, which nobody else
#: touches, and nobody touches the part's first file. All rows are there as before.
_COPY = "p_brand || '/' || CAST(p_partkey AS STRING) || CASE WHEN p_partkey % 10 = 3 THEN '@' || CAST(c_nationkey AS STRING) ELSE '' END"
_TOUCHED = "FROM {lineitem} JOIN {part} ON p_partkey = l_partkey JOIN {orders} ON o_orderkey = l_orderkey JOIN {customer} ON c_custkey = o_custkey"
COPIES = {
    "file": f"""{TABLES["file"]} UNION ALL SELECT DISTINCT {_COPY} AS path, lower(p_type) AS extension, p_brand AS module,
  FALSE AS is_deleted, FALSE AS has_rename_history {_TOUCHED} WHERE p_partkey % 10 = 3""",
    "modified": f"""SELECT CAST(l_orderkey AS STRING) AS hash, {_COPY} AS path, CAST(sum(l_quantity) AS BIGINT) AS additions,
  CAST(sum(l_linenumber) AS BIGINT) AS deletions, 'M' AS change_type {_TOUCHED} GROUP BY l_orderkey, {_COPY}""",
}


def graph(spark: SparkSession, sf_dir: str, settings: Settings | None = None, copies: bool = False, after: int | None = None) -> RepoGraph:
    """The graph of the tables in sf_dir; with copies, one where some files have one author; with after, one of the commits with
    a greater number only, a filter that reaches both scans."""
    base = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in BASE}
    if after is not None:
        base |= {"orders": base["orders"].where(F.col("o_orderkey") > after), "lineitem": base["lineitem"].where(F.col("l_orderkey") > after)}
    queries = TABLES | (COPIES if copies else {})

    def table(name: str) -> DataFrame:
        return spark.sql(queries[name], **{k: v for k, v in base.items() if f"{{{k}}}" in queries[name]})

    tables = {name: table(name) for name in queries}
    none = {"change_count": F.lit(None).cast("long"), "risk_score": F.lit(None).cast("double")}
    tables["function"] = tables["function"].withColumns(none)
    return RepoGraph(**tables, settings=settings or Settings())


def duckdb_ctes(copies: bool = False) -> str:
    """The same tables as common table expressions."""
    parts = []
    for name, sql in (TABLES | (COPIES if copies else {})).items():
        sql = sql.format(**{b: b for b in BASE})
        parts.append(f"{name} AS MATERIALIZED ({sql})")
    return ", ".join(parts)
