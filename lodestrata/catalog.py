"""The registered history and function queries over the proxy graph, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.paths import extension_of, is_bug_fix, module_of
from .functions.scores import is_stale
from .operators import callgraph, client, coupling, files, hotspots, lineage, ownership, paths, resolve, risk, views
from .plans import proxy
from .plans.graph import RepoGraph, Settings
from .plans.materialize import materialize
from .runtime import written
from .sources import diffs, gitlog, pysource, tssource
from .streaming import history

AS_OF = proxy.AS_OF
EMAIL, OTHER = "n3", "n7"
FUNCTION, FILE = "f7::fn27", "f7"
#: Half of the proxy's authors hold no half of a file, so shares count from here.
SHARE = 0.2
Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


def _path(g: RepoGraph) -> str:
    """A file that was renamed twice."""
    return g.file.where(F.col("path").endswith("/22")).select("path").first()[0]


def _with_hotspots(g: RepoGraph, min_commits: int = 8) -> RepoGraph:
    return replace(g, file_hotspot=hotspots.hotspots(g, AS_OF, min_commits))


def query(sql: str | None = None, copies: bool = False, prepare: Callable[[RepoGraph], RepoGraph] | None = None):
    """Registers a function of a graph under its name, with the SQL that follows the common tables."""

    def registered(f: Callable[[RepoGraph], DataFrame]) -> Callable[[RepoGraph], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            g = proxy.graph(spark, sf_dir, copies=copies)
            return _rounded(f(prepare(g) if prepare else g))

        _queries[f.__name__] = run
        if sql:
            _oracles[f.__name__] = f"WITH RECURSIVE {proxy.duckdb_ctes(copies)}, {_COMMON} {sql}"
        return f

    return registered


_P = "(SELECT path FROM file WHERE path LIKE '%/22')"
_DECAY = f"exp(-((epoch(TIMESTAMP '{AS_OF}') - epoch(ts)) / 86400.0) / 180.0)"
_COMMON = """
t AS MATERIALIZED (SELECT m.hash, m.path, c.author_email, c.timestamp, c.ts, c.files_changed FROM modified m JOIN commit c USING (hash)),
anc(root, path, d) AS (SELECT new_path, old_path, 1 FROM renamed_to
  UNION SELECT a.root, r.old_path, a.d + 1 FROM anc a JOIN renamed_to r ON r.new_path = a.path WHERE a.d < 20),
dsc(path, dst, d) AS (SELECT old_path, new_path, 1 FROM renamed_to
  UNION SELECT a.path, r.new_path, a.d + 1 FROM dsc a JOIN renamed_to r ON r.old_path = a.dst WHERE a.d < 20),
lin AS MATERIALIZED (SELECT path AS root, path FROM file UNION SELECT root, path FROM anc),
can AS MATERIALIZED (SELECT path, canonical FROM (SELECT path, path AS canonical FROM file UNION SELECT path, dst FROM dsc) x
  WHERE canonical NOT IN (SELECT old_path FROM renamed_to))"""


def _hot(most: int = 10, least: int = 8) -> str:
    return f""", churn AS (SELECT root, count(DISTINCT hash) AS n, sum({_DECAY}) AS w, count(DISTINCT author_email) AS a
  FROM lin JOIN t USING (path) WHERE root IN (SELECT path FROM file WHERE NOT is_deleted) GROUP BY root HAVING count(DISTINCT hash) >= {least}),
partner AS (SELECT l.root, c.canonical, max(exp(-((epoch(TIMESTAMP '{AS_OF}') - epoch(a.ts)) / 86400.0) / 180.0)) AS mw
  FROM lin l JOIN t a ON a.path = l.path AND a.files_changed <= {most} JOIN t b ON b.hash = a.hash JOIN can c ON c.path = b.path
  WHERE NOT EXISTS (SELECT 1 FROM lin x WHERE x.root = l.root AND x.path = b.path) GROUP BY l.root, c.canonical),
hot AS MATERIALIZED (SELECT f.path, f.module, n AS commit_count, k AS coupled_file_count, a AS author_count, k / n AS coupling_density,
  k / n * (1.0::DOUBLE / a) * ln(n + 1) AS risk_score, cw / w * (1.0::DOUBLE / a) * ln(w + 1) AS risk_score_recent
  FROM churn JOIN (SELECT root, count(*) AS k, sum(mw) AS cw FROM partner GROUP BY root) p USING (root) JOIN file f ON f.path = root)"""


_HOT_COLUMNS = """path, module, commit_count, coupled_file_count, author_count, round(coupling_density, 6) AS coupling_density,
  round(risk_score, 6) AS risk_score, round(risk_score_recent, 6) AS risk_score_recent"""

# --- repository and hotspots


@query("""SELECT (SELECT count(*) FROM file) AS file_count, count(*) AS commit_count, (SELECT count(*) FROM author) AS author_count,
  (SELECT count(DISTINCT module) FROM file) AS module_count, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM commit""")
def repo_stats(g):
    return files.repo_stats(g)


@query(f"{_hot()} SELECT {_HOT_COLUMNS} FROM hot")
def hotspots_all(g):
    return hotspots.hotspots(g, AS_OF)


@query(f"{_hot()} SELECT {_HOT_COLUMNS} FROM hot ORDER BY hot.risk_score DESC, path LIMIT 20")
def hotspots_top(g):
    return hotspots.hotspots(g, AS_OF, limit=20)


@query(f"{_hot()} SELECT path, module, commit_count, coupled_file_count, author_count, round(coupling_density, 3) AS coupling_density, round(hot.risk_score, 3) AS risk_score, "
       "round(hot.risk_score_recent, 3) AS risk_score_recent FROM hot ORDER BY hot.risk_score DESC, path LIMIT 20", prepare=lambda g: materialize(g, AS_OF, ("file_hotspot",)))  # fmt: skip
def hotspots_made(g):
    """What was materialized, as the parameters are the same."""
    return hotspots.hotspots_or_scored(g, AS_OF)


@query(f"{_hot(5)} SELECT path, module, commit_count, coupled_file_count, author_count, round(coupling_density, 3) AS coupling_density, round(hot.risk_score, 3) AS risk_score, "
       "round(hot.risk_score_recent, 3) AS risk_score_recent FROM hot ORDER BY hot.risk_score DESC, path LIMIT 20", prepare=lambda g: materialize(g, AS_OF, ("file_hotspot",)))  # fmt: skip
def hotspots_live(g):
    """The live query, as the parameters differ from what was materialized."""
    return hotspots.hotspots_or_scored(g, AS_OF, max_files=5)


@query(f"{_hot(5)} SELECT {_HOT_COLUMNS} FROM hot ORDER BY hot.risk_score DESC, path LIMIT 50")
def hotspots_few_files(g):
    return hotspots.hotspots(g, AS_OF, max_files_per_commit=5, limit=50)


@query(f"{_hot()} SELECT {_HOT_COLUMNS} FROM hot JOIN file f USING (path) WHERE f.has_rename_history".replace("SELECT path, module,", "SELECT path, hot.module,"))
def hotspots_rollup(g):
    return hotspots.hotspots(g, AS_OF).join(g.file.where("has_rename_history").select("path"), "path", "left_semi")


_FEW = """, few AS (SELECT * FROM (SELECT * FROM hot ORDER BY risk_score DESC, path LIMIT 160) h ORDER BY {score} DESC, path LIMIT 40)"""


@query(_hot() + _FEW.format(score="risk_score_recent") + """ SELECT path AS id, string_split(path, '/')[-1] AS label, round(risk_score_recent, 6) AS score,
  round(round(risk_score_recent / max(risk_score_recent) OVER (), 3), 6) AS weight, (SELECT count(DISTINCT author_email) FROM t WHERE t.path = few.path) = 1 AS sole_owned,
  risk_score_recent > risk_score * 1.1 AS trending_worse, CASE WHEN risk_score_recent / max(risk_score_recent) OVER () >= 0.66 THEN 'high'
  WHEN risk_score_recent / max(risk_score_recent) OVER () >= 0.33 THEN 'medium' ELSE 'low' END AS band FROM few""", prepare=_with_hotspots)
def repo_map_nodes(g):
    return hotspots.repo_map_nodes(g, "recent")


@query(_hot() + _FEW.format(score="risk_score") + """, pairs AS (SELECT a.path AS source, b.path AS target, count(DISTINCT a.hash) AS n FROM t a JOIN t b ON a.hash = b.hash AND a.path < b.path
  WHERE a.files_changed <= 10 AND a.path IN (SELECT path FROM few) AND b.path IN (SELECT path FROM few) GROUP BY 1, 2 ORDER BY n DESC, source, target LIMIT 120),
  dense AS (SELECT source, target, n / least(x.commit_count, y.commit_count) AS d FROM pairs JOIN few x ON x.path = source JOIN few y ON y.path = target)
  SELECT source, target, round(d / max(d) OVER () * 10, 2) AS weight FROM dense""", prepare=_with_hotspots)
def repo_map_edges(g):
    return hotspots.repo_map_edges(g, min_shared=1)


@query(f"{_hot()}, x AS (SELECT * FROM hot ORDER BY risk_score DESC, path LIMIT 20) SELECT path, CASE WHEN risk_score / max(risk_score) OVER () >= 0.75 THEN 'critical' "
       "WHEN risk_score / max(risk_score) OVER () >= 0.5 THEN 'serious' WHEN risk_score / max(risk_score) OVER () >= 0.25 THEN 'warning' ELSE 'good' END AS tier FROM x")  # fmt: skip
def risk_tiers(g):
    return hotspots.with_tiers(hotspots.hotspots(g, AS_OF, limit=20)).select("path", "tier")


@query(f"{_hot()}, x AS (SELECT * FROM hot ORDER BY risk_score DESC, path LIMIT 12) SELECT path, row_number() OVER (ORDER BY risk_score_recent DESC NULLS LAST, path) AS rank FROM x")
def hotspots_recent(g):
    return hotspots.rerank_recent(hotspots.hotspots(g, AS_OF)).select("path", F.col("rank").cast("long"))


# --- lineage


@query("SELECT root, path FROM lin")
def rename_lineage(g):
    return lineage.lineage(g)


@query("SELECT path, canonical FROM can")
def rename_canonical(g):
    return lineage.canonical(g)


@query("SELECT path, path NOT IN (SELECT path FROM t) AS is_deleted FROM file", copies=True)
def mark_deleted(g):
    return lineage.mark_deleted(g.file, g.modified.select("path")).select("path", "is_deleted")


@query("SELECT path, path IN (SELECT new_path FROM renamed_to) AS has_rename_history FROM file")
def rename_history(g):
    return lineage.rename_history(g.file, g.renamed_to).select("path", "has_rename_history")


@query("SELECT path, string_split(path, '/')[1] AS module, '' AS extension FROM file")
def path_parts(g):
    return g.file.select("path", module_of(F.col("path")).alias("module"), extension_of(F.col("path")).alias("extension"))


# --- files


@query(f"""SELECT f.path, f.extension, f.module, f.is_deleted, s.commit_count, s.first_ts, s.last_ts, NULL::VARCHAR AS renamed_to
  FROM file f, (SELECT count(*) AS commit_count, min(timestamp) AS first_ts, max(timestamp) AS last_ts FROM t JOIN lin USING (path) WHERE root = {_P}) s
  WHERE f.path = {_P}""")
def file_detail(g):
    return files.file_detail(g, _path(g)).drop("risk_score", "risk_score_recent")


@query(f"""SELECT hash, message, name AS author_name, timestamp, m.additions, m.deletions FROM lin JOIN modified m USING (path)
  JOIN commit c USING (hash) JOIN author ON email = author_email WHERE root = {_P} ORDER BY timestamp DESC, hash, m.path LIMIT 15""")
def file_recent_commits(g):
    return files.file_recent_commits(g, _path(g))


@query(f"""SELECT name AS author_name, author_email, n AS commit_count, round(n / sum(n) OVER (), 6) AS share FROM (SELECT author_email, count(DISTINCT hash) AS n
  FROM lin JOIN t USING (path) WHERE root = {_P} GROUP BY author_email) JOIN author ON email = author_email ORDER BY n DESC, author_email LIMIT 10""")
def file_owners(g):
    return ownership.file_owners(g, _path(g))


_CO = f"""SELECT f.path, f.module, n AS shared_commits FROM (SELECT canonical AS path, count(DISTINCT a.hash) AS n FROM lin l JOIN t a ON a.path = l.path
  JOIN t b ON b.hash = a.hash JOIN can ON can.path = b.path WHERE l.root = {_P} AND a.files_changed <= 10
  AND b.path NOT IN (SELECT path FROM lin WHERE root = {_P}) GROUP BY 1) JOIN file f USING (path) WHERE NOT f.is_deleted AND n >= {{least}}
  ORDER BY n DESC, path LIMIT {{limit}}"""


@query(_CO.format(least=1, limit=500))
def file_co_changes(g):
    return coupling.co_changes(g, _path(g), limit=500)


@query(_CO.format(least=2, limit=12))
def blast_radius_direct(g):
    return coupling.blast_radius_direct(g, _path(g))


@query(f"""SELECT via, f.path, f.module, n AS shared_commits FROM (SELECT c.path AS via, d.path, count(DISTINCT c.hash) AS n FROM t c JOIN t d ON c.hash = d.hash
  WHERE c.files_changed <= 10 AND d.path NOT IN (c.path, {_P}) AND c.path IN (SELECT b.path FROM t a JOIN t b ON a.hash = b.hash JOIN file g ON g.path = b.path
    WHERE a.path = {_P} AND b.path <> a.path AND a.files_changed <= 10 AND NOT g.is_deleted) GROUP BY 1, 2) JOIN file f USING (path)
  WHERE NOT f.is_deleted AND n >= 2 ORDER BY n DESC, via, path LIMIT 24""")
def blast_radius_transitive(g):
    return coupling.blast_radius_transitive(g, _path(g))


@query("""SELECT f.path, f.extension, f.module, f.is_deleted, (SELECT count(*) FROM modified m WHERE m.path = f.path) AS commit_count, NULL::DOUBLE AS risk_score
  FROM file f WHERE contains(lower(f.path), '#3') ORDER BY commit_count DESC, f.path LIMIT 50""")
def search_files(g):
    return files.list_files(g, "#3")


@query(f"""{_hot()} SELECT f.path, f.extension, f.module, f.is_deleted, (SELECT count(*) FROM modified m WHERE m.path = f.path) AS commit_count,
  round(hot.risk_score, 6) AS risk_score FROM file f LEFT JOIN hot USING (path) ORDER BY hot.risk_score DESC NULLS LAST, commit_count DESC, f.path LIMIT 60""",
       prepare=_with_hotspots)
def search_files_by_risk(g):
    return files.list_files(g, "", 60, "risk")


@query("""SELECT hash, message, name AS author_name, timestamp FROM commit JOIN author ON email = author_email
  WHERE contains(lower(message), 'bug #1 2') ORDER BY timestamp DESC, hash LIMIT 8""")
def search_commits(g):
    return files.search_commits(g, "BUG #1 2")


@query(_oracles["search_commits"].split(_COMMON)[1])
def search_commits_indexed(g):
    """The same rows, from the posting lists of the term's trigrams."""
    return files.search_commits_indexed(g, files.text_index(g.commit, "hash", "message"), "BUG #1 2")


@query(_oracles["search_files"].split(_COMMON)[1])
def search_files_indexed(g):
    return files.list_files_indexed(g, files.text_index(g.file, "path", "path"), "#3")


# --- paths between authors

_NEAR = f"""SELECT min(a.path) AS f FROM t a JOIN t b USING (path) WHERE a.author_email = '{EMAIL}' AND b.author_email = '{OTHER}' HAVING min(a.path) IS NOT NULL"""


@query(f"""SELECT 0 AS step, 'Author' AS kind, '{EMAIL}' AS id FROM ({_NEAR}) UNION ALL SELECT 1, 'File', f FROM ({_NEAR}) UNION ALL SELECT 2, 'Author', '{OTHER}' FROM ({_NEAR})""")
def author_path_steps(g):
    return paths.steps(g.touches.select(F.col("author_email").alias("email"), "path"), EMAIL, OTHER)


# --- authors

_STATS = """stats AS (SELECT email, name, count(DISTINCT c.hash) AS commit_count, count(DISTINCT m.path) AS file_count, min(timestamp) AS first_ts, max(timestamp) AS last_ts
  FROM author JOIN commit c ON author_email = email LEFT JOIN modified m USING (hash) GROUP BY email, name)"""


@query(f", {_STATS} SELECT * FROM stats")
def author_stats(g):
    return ownership.author_stats(g)


@query(f", {_STATS} SELECT * FROM stats ORDER BY commit_count DESC, email LIMIT 10 OFFSET 5")
def author_list(g):
    return ownership.author_list(g, limit=10, offset=5)


@query(f", {_STATS} SELECT * FROM stats WHERE contains(lower(name), 'n1') ORDER BY commit_count DESC, email LIMIT 30".replace("'n1'", "'_1'"))
def author_search(g):
    return ownership.author_list(g, "_1")


@query(f", {_STATS} SELECT * FROM stats WHERE email = '{EMAIL}'")
def author_detail(g):
    return ownership.author_detail(g, EMAIL)


@query(f"SELECT f.path, f.module, count(*) AS commit_count FROM t JOIN file f USING (path) WHERE author_email = '{EMAIL}' GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10")
def author_top_files(g):
    return ownership.author_top_files(g, EMAIL)


@query(f"SELECT f.module AS name, count(*) AS touches FROM t JOIN file f USING (path) WHERE author_email = '{EMAIL}' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8")
def author_top_modules(g):
    return ownership.author_top_modules(g, EMAIL)


@query(f"""SELECT '{EMAIL}' AS a1_email, (SELECT name FROM author WHERE email = '{EMAIL}') AS a1_name, min(a.path) AS file_path, '{OTHER}' AS a2_email,
  (SELECT name FROM author WHERE email = '{OTHER}') AS a2_name FROM t a JOIN t b USING (path) WHERE a.author_email = '{EMAIL}' AND b.author_email = '{OTHER}' HAVING min(a.path) IS NOT NULL""")
def author_direct_connection(g):
    return ownership.direct_connection(g, EMAIL, OTHER)


@query(f"""SELECT '{EMAIL}' AS a1_email, (SELECT name FROM author WHERE email = '{EMAIL}') AS a1_name, f1 AS file_path_1, x.bridge AS bridge_email, name AS bridge_name, f2 AS file_path_2,
  '{OTHER}' AS a2_email, (SELECT name FROM author WHERE email = '{OTHER}') AS a2_name FROM
  (SELECT b.author_email AS bridge, min(b.path) AS f1 FROM t a JOIN t b USING (path) WHERE a.author_email = '{EMAIL}' AND b.author_email NOT IN ('{EMAIL}', '{OTHER}') GROUP BY 1) x
  JOIN (SELECT b.author_email AS bridge, min(b.path) AS f2 FROM t a JOIN t b USING (path) WHERE a.author_email = '{OTHER}' AND b.author_email NOT IN ('{EMAIL}', '{OTHER}') GROUP BY 1) y USING (bridge)
  JOIN author ON email = x.bridge ORDER BY x.bridge LIMIT 1""")
def author_bridge_connection(g):
    return ownership.bridge_connection(g, EMAIL, OTHER)


@query(f"""SELECT author_email AS email, name, count(DISTINCT t.path) AS shared_files FROM t JOIN author ON email = author_email WHERE author_email <> '{EMAIL}' AND t.path IN
  (SELECT path FROM (SELECT path, count(DISTINCT hash) AS n FROM t JOIN file f USING (path) WHERE author_email = '{EMAIL}' AND NOT is_deleted GROUP BY 1 ORDER BY n DESC, path LIMIT 80))
  GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 15""")
def author_network(g):
    return ownership.author_network(g, EMAIL)


@query(f"""SELECT t.path, f.module, count(DISTINCT hash) AS commit_count, max(timestamp) AS last_touched FROM t JOIN file f USING (path) WHERE NOT is_deleted GROUP BY 1, 2
  HAVING count(DISTINCT author_email) = 1 AND min(author_email) = '{EMAIL}' ORDER BY 3 DESC, 1 LIMIT 15""", copies=True)
def author_sole_owned_files(g):
    return ownership.author_sole_owned_files(g, EMAIL)


@query("SELECT path FROM t GROUP BY path HAVING count(DISTINCT author_email) = 1", copies=True)
def sole_ownership(g):
    return ownership.sole_owned(g, g.file)


_CRITICAL = f"""share AS (SELECT path, author_email AS email, count(DISTINCT hash) / sum(count(DISTINCT hash)) OVER (PARTITION BY path) AS s FROM t GROUP BY 1, 2),
critical AS (SELECT email, sum(coalesce(risk_score, 0) * s * CASE WHEN s = 1 THEN 1.5 ELSE 1 END + CASE WHEN s = 1 THEN 0.1 ELSE 0 END) AS criticality_score,
  count(*) FILTER (s = 1) AS sole_owned_file_count FROM share JOIN file f USING (path) LEFT JOIN hot USING (path) WHERE s >= {{share}} AND NOT is_deleted GROUP BY 1)"""


@query(f"{_hot()}, {_CRITICAL.format(share=SHARE)} SELECT email, name, round(criticality_score, 6) AS criticality_score, sole_owned_file_count FROM critical JOIN author USING (email)", prepare=_with_hotspots)
def author_criticality(g):
    return ownership.criticality(g, SHARE)


@query(f"{_hot(10, 1)}, {_CRITICAL.format(share=0.5)} SELECT email, name, round(criticality_score, 6) AS criticality_score, sole_owned_file_count FROM critical JOIN author USING (email)",
       copies=True, prepare=lambda g: _with_hotspots(g, 1))
def author_criticality_sole(g):
    return ownership.criticality(g)


@query(f"{_hot()}, {_CRITICAL.format(share=SHARE)}, {_STATS} SELECT email, c.name, round(criticality_score, 6) AS criticality_score, sole_owned_file_count, last_ts AS last_commit_at, "
       f"floor((epoch(TIMESTAMP '{AS_OF}') - epoch(last_ts::TIMESTAMP)) / 86400) > 180 AS is_stale FROM (SELECT * FROM critical JOIN author USING (email)) c JOIN stats USING (email) "
       "ORDER BY c.criticality_score DESC, email LIMIT 20", prepare=lambda g: materialize(replace(g, settings=Settings(concentration=SHARE)), AS_OF))  # fmt: skip
def critical_authors(g):
    return ownership.critical_authors(g, AS_OF)


@query(f"SELECT author_email AS email, floor((epoch(TIMESTAMP '{AS_OF}') - epoch(max(ts))) / 86400) > 3 AS is_stale FROM commit GROUP BY 1")
def author_stale(g):
    return g.commit.groupBy(F.col("author_email").alias("email")).agg(F.max("ts").alias("last")).select("email", is_stale(F.col("last"), AS_OF, 3).alias("is_stale"))


@query("""SELECT email, module AS primary_module FROM (SELECT author_email AS email, module, row_number() OVER (PARTITION BY author_email ORDER BY count(DISTINCT hash) DESC, module) AS r
  FROM t JOIN file USING (path) GROUP BY author_email, module) WHERE r = 1""")
def topology_primary_module(g):
    return ownership.primary_modules(g, g.author)


@query(f""", {_STATS}, few AS (SELECT * FROM stats ORDER BY commit_count DESC, email LIMIT 10), own AS (SELECT path, author_email AS email FROM t JOIN file f USING (path)
  WHERE NOT is_deleted AND author_email IN (SELECT email FROM few) GROUP BY 1, 2 HAVING count(DISTINCT hash) >= 2), usual AS (SELECT path FROM own GROUP BY 1 HAVING count(*) BETWEEN 2 AND 8)
  SELECT a.email AS email_a, b.email AS email_b, count(*) AS shared_files FROM own a JOIN own b USING (path) JOIN usual USING (path) WHERE a.email < b.email GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 120""")
def topology_shared_files(g):
    return ownership.shared_file_pairs(g, ownership.author_list(g, limit=10))


@query(f""", {_STATS}, few AS (SELECT * FROM stats ORDER BY commit_count DESC, email LIMIT 10) SELECT email, name, commit_count, round(commit_count / max(commit_count) OVER (), 3) AS weight,
  primary_module FROM few JOIN (SELECT author_email AS email, module AS primary_module FROM (SELECT author_email, module, row_number() OVER (PARTITION BY author_email ORDER BY count(DISTINCT hash) DESC, module) AS r
  FROM t JOIN file USING (path) GROUP BY author_email, module) WHERE r = 1) USING (email)""")
def topology_nodes(g):
    return ownership.topology_nodes(g, 10)


# --- modules

_MODULES = """modules AS (SELECT a.module AS module_a, b.module AS module_b, count(DISTINCT x.hash) AS shared_commits FROM t x JOIN file a ON a.path = x.path JOIN t y ON y.hash = x.hash
  JOIN file b ON b.path = y.path WHERE x.files_changed BETWEEN 2 AND {most} AND a.module < b.module GROUP BY 1, 2 HAVING count(DISTINCT x.hash) >= 2)"""


@query("""SELECT f.module AS name, count(DISTINCT f.path) AS file_count, count(DISTINCT hash) AS commit_count, count(DISTINCT author_email) AS author_count
  FROM file f LEFT JOIN t USING (path) WHERE NOT is_deleted GROUP BY 1""")
def module_list(g):
    return files.module_list(g)


@query(f", {_MODULES.format(most=5)} SELECT * FROM modules ORDER BY shared_commits DESC, module_a, module_b LIMIT 25")
def module_coupling(g):
    return coupling.module_coupling(g, max_files=5)


@query(f", {_MODULES.format(most=10)} SELECT * FROM modules")
def module_coupling_all(g):
    return coupling.module_coupling(g, limit=None)


@query(f", {_MODULES.format(most=10)}, few AS (SELECT * FROM modules ORDER BY shared_commits DESC, module_a, module_b LIMIT 40), ends AS (SELECT module, sum(s)::BIGINT AS total FROM "
       "(SELECT module_a AS module, shared_commits AS s FROM few UNION ALL SELECT module_b, shared_commits FROM few) GROUP BY 1) SELECT module, total, round(total / max(total) OVER (), 3) AS weight FROM ends")  # fmt: skip
def module_graph_nodes(g):
    return coupling.module_graph_nodes(coupling.module_coupling(g, limit=40))


@query("""SELECT a.path AS path_a, b.path AS path_b, count(DISTINCT a.hash) AS shared_commits FROM t a JOIN t b ON a.hash = b.hash AND a.path < b.path JOIN file x ON x.path = a.path JOIN file y ON y.path = b.path
  WHERE a.files_changed <= 10 AND x.module = 'Brand#11' AND y.module = 'Brand#11' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 120""")
def coupling_among(g):
    return coupling.coupling_among(g, g.file.where("module = 'Brand#11'"), min_shared=1)


# --- functions

_BRIEF = "id, name, qualname, path, language"
_HISTORY = """hist AS (SELECT f.id, count(DISTINCT h.hash) AS change_count, count(DISTINCT CASE WHEN h.message LIKE 'fix:%' OR h.message LIKE 'bug %' THEN h.hash END) AS bug_fix_count
  FROM function f LEFT JOIN hunks h ON h.path = f.path AND h.lo <= f.end_line AND h.hi >= f.start_line GROUP BY 1),
scored AS (SELECT f.*, change_count, (SELECT count(*) FROM calls WHERE callee_id = f.id) AS caller_count,
  round(ln(1 + change_count) * ln(1 + (SELECT count(*) FROM calls WHERE callee_id = f.id)) * ln(1 + complexity), 4) AS risk_score FROM function f JOIN hist USING (id))"""
_COUNTS = f"""counted AS (SELECT {_BRIEF}, start_line, end_line, is_exported, is_method, (SELECT count(DISTINCT caller_id) FROM calls WHERE callee_id = f.id) AS caller_count,
  (SELECT count(DISTINCT callee_id) FROM calls WHERE caller_id = f.id) AS callee_count, change_count, risk_score FROM scored f)"""


def _with_risk(g: RepoGraph) -> RepoGraph:
    return replace(g, function=risk.with_risk(g.function, g.calls, risk.change_history(g.function, g.hunks)))


@query(f"SELECT {_BRIEF}, start_line, end_line, is_exported, is_method FROM function WHERE path = '{FILE}'")
def file_functions(g):
    return callgraph.file_functions(g, FILE)


@query(f", {_HISTORY}, {_COUNTS} SELECT * FROM counted WHERE path = '{FILE}'", prepare=_with_risk)
def file_functions_with_counts(g):
    return callgraph.file_functions_with_counts(g, FILE)


@query(f", {_HISTORY}, {_COUNTS} SELECT * FROM counted WHERE contains(lower(qualname), 'fn1') OR contains(lower(path), 'fn1') ORDER BY caller_count DESC, qualname LIMIT 40", prepare=_with_risk)
def functions_list(g):
    return callgraph.functions_list(g, "FN1", limit=40)


@query(f", {_HISTORY}, {_COUNTS} SELECT * FROM counted ORDER BY risk_score DESC, qualname LIMIT 60", prepare=_with_risk)
def functions_by_risk(g):
    return callgraph.functions_list(g, "", "risk", 60)


@query(f"""SELECT {_BRIEF}, caller_count, round(caller_count / max(caller_count) OVER (), 3) AS weight FROM (SELECT callee_id AS id, count(DISTINCT caller_id) AS caller_count
  FROM calls GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60) JOIN function USING (id)""")
def function_map_candidates(g):
    return callgraph.map_candidates(g)


@query("""SELECT caller_id AS source, callee_id AS target, confidence, call_count FROM calls WHERE caller_id IN (SELECT id FROM function WHERE is_method)
  AND callee_id IN (SELECT id FROM function WHERE is_method) ORDER BY call_count DESC, source, target LIMIT 150""")
def function_map_edges(g):
    return callgraph.map_edges(g, g.function.where("is_method"))


@query(f"SELECT {_BRIEF}, start_line, end_line, is_exported, is_method, source FROM function WHERE id = '{FUNCTION}'")
def function_detail(g):
    return callgraph.function_detail(g, FUNCTION)


def _near(a: str, b: str, limit: str) -> str:
    return f"SELECT {_BRIEF}, confidence, call_count FROM calls JOIN function ON id = {b} WHERE {a} = '{FUNCTION}' ORDER BY call_count DESC, id {limit}"


@query(_near("callee_id", "caller_id", "LIMIT 30"))
def function_callers(g):
    return callgraph.neighbours(g, FUNCTION, "callers", 30)


@query(_near("caller_id", "callee_id", "LIMIT 30"))
def function_callees(g):
    return callgraph.neighbours(g, FUNCTION, "callees", 30)


@query(_near("caller_id", "callee_id", ""))
def function_callees_all(g):
    return callgraph.neighbours(g, FUNCTION, "callees")


def _far(a: str, b: str) -> str:
    return f"""SELECT via, {_BRIEF}, confidence, call_count FROM (SELECT y.{a} AS via, y.{b} AS id, y.confidence, y.call_count FROM calls x JOIN calls y ON y.{a} = x.{b}
  WHERE x.{a} = '{FUNCTION}' AND y.{b} NOT IN ('{FUNCTION}', y.{a})) JOIN function USING (id) ORDER BY call_count DESC, via, id LIMIT 24"""


@query(_far("caller_id", "callee_id"))
def call_graph_callees_transitive(g):
    return callgraph.second_neighbours(g, FUNCTION, "callees")


@query(_far("callee_id", "caller_id"))
def call_graph_callers_transitive(g):
    return callgraph.second_neighbours(g, FUNCTION, "callers")


@query(f"""SELECT caller_id AS source, callee_id AS target, b.path AS target_path, b.name AS target_name, b.qualname AS target_qualname, b.language AS target_language, confidence, call_count
  FROM calls JOIN function a ON a.id = caller_id JOIN function b ON b.id = callee_id WHERE a.path = '{FILE}'""")
def file_call_graph(g):
    return callgraph.file_call_graph(g, FILE)


@query(f"""SELECT id, path, name, 1 AS hop, 1.0::DOUBLE AS weight FROM function WHERE path = '{FILE}' UNION ALL SELECT DISTINCT b.id, b.path, b.name, 2, 0.6::DOUBLE FROM calls
  JOIN function a ON a.id = caller_id JOIN function b ON b.id = callee_id WHERE a.path = '{FILE}' AND b.path <> '{FILE}'""")
def file_call_nodes(g):
    return callgraph.file_call_nodes(g, FILE)


# --- response graphs and what a client makes of lists


def _view(name: str, sql: str, prepare: Callable[[RepoGraph], RepoGraph] | None = None):
    """Registers nodes or edges of a response graph."""

    def registered(f: Callable[[RepoGraph], views.GraphView]) -> Callable[[RepoGraph], views.GraphView]:
        def run(g: RepoGraph) -> DataFrame:
            nodes, edges = f(g).frames(g.file.sparkSession)
            return nodes if name.endswith("nodes") else edges

        run.__name__ = name
        query(sql, prepare=prepare)(run)
        return f

    return registered


@_view("topology_view_nodes", f""", {_STATS}, few AS (SELECT * FROM stats ORDER BY commit_count DESC, email LIMIT 10) SELECT email AS id, 'Author' AS kind, name AS label, name || ' - mostly works in ' || module AS subtitle, 1 AS hop,
  round(commit_count / max(commit_count) OVER (), 3) AS weight, false AS sole_owned, false AS trending_worse, module AS "group" FROM few JOIN (SELECT author_email AS email, module FROM (SELECT author_email, module,
  row_number() OVER (PARTITION BY author_email ORDER BY count(DISTINCT hash) DESC, module) AS r FROM t JOIN file USING (path) GROUP BY author_email, module) WHERE r = 1) USING (email)""")
def _topology(g):
    return views.topology_view(g, 10)


@_view("author_network_view_nodes", f""", few AS (SELECT path FROM (SELECT path, count(DISTINCT hash) AS n FROM t JOIN file f USING (path) WHERE author_email = '{EMAIL}' AND NOT is_deleted GROUP BY 1 ORDER BY n DESC, path LIMIT 80)),
  near AS (SELECT author_email AS id, name, count(DISTINCT t.path) AS n FROM t JOIN author ON email = author_email WHERE author_email <> '{EMAIL}' AND t.path IN (SELECT path FROM few) GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 15)
  SELECT id, 'Author' AS kind, name AS label, CAST(n AS STRING) || ' shared file' || CASE WHEN n = 1 THEN '' ELSE 's' END AS subtitle, 1 AS hop, round(n / max(n) OVER (), 3) AS weight, false AS sole_owned, false AS trending_worse, '' AS "group" FROM near
  UNION ALL SELECT email, 'Author', name, email, 0, 1.0::DOUBLE, false, false, '' FROM author WHERE email = '{EMAIL}'""")
def _network(g):
    return views.author_network_view(g, EMAIL)


@_view("module_view_nodes", f""", {_MODULES.format(most=10)}, few AS (SELECT * FROM modules ORDER BY shared_commits DESC, module_a, module_b LIMIT 40), ends AS (SELECT module, sum(s) AS total FROM
  (SELECT module_a AS module, shared_commits AS s FROM few UNION ALL SELECT module_b, shared_commits FROM few) GROUP BY 1) SELECT module AS id, 'Module' AS kind, module AS label, module AS subtitle, 1 AS hop,
  round(total / max(total) OVER (), 3) AS weight, false AS sole_owned, false AS trending_worse, '' AS "group" FROM ends""")
def _modules(g):
    return views.module_view(g)


@_view("function_map_view_nodes", f"""SELECT id, 'Function' AS kind, name AS label, path || ' - ' || qualname || ' - ' || CAST(n AS STRING) || ' callers' AS subtitle, 1 AS hop, round(n / max(n) OVER (), 3) AS weight, false AS sole_owned,
  false AS trending_worse, language AS "group" FROM (SELECT callee_id AS id, count(DISTINCT caller_id) AS n FROM calls GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 60) JOIN function USING (id)""")
def _function_map(g):
    return views.function_map(g)


@_view("file_call_view_edges", f"""SELECT caller_id AS source, callee_id AS target, CAST(call_count AS DOUBLE) AS weight, confidence FROM calls JOIN function a ON a.id = caller_id JOIN function b ON b.id = callee_id WHERE a.path = '{FILE}'""")
def _file_calls(g):
    return views.file_call_view(g, FILE)


@_view("call_graph_view_nodes", f""", near AS (SELECT * FROM (SELECT callee_id AS id, call_count AS n FROM calls WHERE caller_id = '{FUNCTION}' ORDER BY n DESC, id LIMIT 12) UNION ALL
  SELECT * FROM (SELECT caller_id, call_count FROM calls WHERE callee_id = '{FUNCTION}' ORDER BY 2 DESC, 1 LIMIT 12)), one AS (SELECT id, n, row_number() OVER (PARTITION BY id ORDER BY (SELECT 1)) AS k FROM near)
  SELECT id, 'Function' AS kind, name AS label, path || ' - ' || qualname AS subtitle, 1 AS hop, round((SELECT arg_min(n, o) FROM (SELECT callee_id AS i, call_count AS n, 0 AS o FROM calls WHERE caller_id = '{FUNCTION}'
  AND callee_id IN (SELECT callee_id FROM calls WHERE caller_id = '{FUNCTION}' ORDER BY call_count DESC, callee_id LIMIT 12) UNION ALL SELECT caller_id, call_count, 1 FROM calls WHERE callee_id = '{FUNCTION}') x WHERE x.i = f.id)
  / (SELECT max(n) FROM near), 3) AS weight, false AS sole_owned, false AS trending_worse, language AS "group" FROM function f WHERE id IN (SELECT id FROM near)
  UNION ALL SELECT id, 'Function', name, path || ' - ' || qualname, 0, 1.0::DOUBLE, false, false, language FROM function WHERE id = '{FUNCTION}'""")
def _call_graph(g):
    return views.call_graph(g, FUNCTION, depth=1)


@_view("blast_radius_view_nodes", f""", near AS ({_CO.format(least=2, limit=12)}) SELECT path AS id, 'File' AS kind, string_split(path, '/')[-1] AS label, path AS subtitle, 1 AS hop, round(shared_commits / max(shared_commits) OVER (), 3) AS weight,
  false AS sole_owned, false AS trending_worse, '' AS "group" FROM near UNION ALL SELECT {_P}, 'File', '22', {_P}, 0, 1.0::DOUBLE, false, false, ''""")
def _blast(g):
    return views.blast_radius(g, _path(g), depth=1)


_PLAIN = "false AS sole_owned, false AS trending_worse"


def _folded(root: str, most: int, turned: int = -1, directed: bool = False) -> str:
    """Second-degree rows (second: i, side, via, id, n) taken in their order: what is seen, added and drawn after each."""
    a, b = f"CASE WHEN side = {turned} THEN id ELSE via END", f"CASE WHEN side = {turned} THEN via ELSE id END"
    pair = f"{a} || ' ' || {b}" if directed else f"least({a}, {b}) || ' ' || greatest({a}, {b})"
    return f"""st(i, seen, added, pairs, edges, ended, cut) AS (SELECT 0::BIGINT, list_append((SELECT list(DISTINCT id) FROM near), {root}), []::STRUCT(id VARCHAR, n BIGINT)[],
    (SELECT list({pair.replace("via", root)}) FROM near), []::STRUCT(source VARCHAR, target VARCHAR, n BIGINT)[], []::INT[], false
  UNION ALL SELECT j, CASE WHEN new THEN list_append(seen, id) ELSE seen END, CASE WHEN new THEN list_append(added, {{'id': id, 'n': n}}) ELSE added END,
    CASE WHEN drawn THEN list_append(pairs, pair) ELSE pairs END, CASE WHEN drawn THEN list_append(edges, {{'source': {a}, 'target': {b}, 'n': n}}) ELSE edges END,
    CASE WHEN ends THEN list_append(ended, side) ELSE ended END, cut OR ends FROM (SELECT *, reach AND NOT known AND NOT over AS new, reach AND NOT known AND over AS ends,
      reach AND NOT (NOT known AND over) AND NOT list_contains(pairs, pair) AS drawn FROM (SELECT st.*, s.i AS j, s.side, s.via, s.id, s.n, list_contains(seen, s.via) AND NOT list_contains(ended, s.side) AS reach,
      list_contains(seen, s.id) AS known, len(seen) >= {most} AS over, {pair} AS pair FROM st JOIN second s ON s.i = st.i + 1))),
  fin AS (SELECT * FROM st WHERE i = (SELECT max(i) FROM st))"""


_DEEP_FILE = f""", near AS (SELECT path AS id, shared_commits AS n, 0 AS side FROM ({_CO.format(least=1, limit=50)})),
  second AS (SELECT row_number() OVER (ORDER BY n DESC, via, id) AS i, 0 AS side, * FROM (SELECT via, f.path AS id, n FROM (SELECT c.path AS via, d.path, count(DISTINCT c.hash) AS n FROM t c JOIN t d ON c.hash = d.hash
    WHERE c.files_changed <= 10 AND d.path NOT IN (c.path, {_P}) AND c.path IN (SELECT b.path FROM t a JOIN t b ON a.hash = b.hash JOIN file g ON g.path = b.path
      WHERE a.path = {_P} AND b.path <> a.path AND a.files_changed <= 10 AND NOT g.is_deleted) GROUP BY 1, 2) JOIN file f USING (path)
    WHERE NOT f.is_deleted ORDER BY n DESC, via, id LIMIT 100) WHERE EXISTS (SELECT 1 FROM near)), {_folded(_P, 101)}"""


@_view("blast_radius_deep_nodes", f"""{_DEEP_FILE} SELECT id, 'File' AS kind, string_split(id, '/')[-1] AS label, id AS subtitle, hop, round(w, 3) AS weight, {_PLAIN}, '' AS "group" FROM (
  SELECT {_P} AS id, 0 AS hop, 1.0::DOUBLE AS w UNION ALL SELECT id, 1, n / max(n) OVER () FROM near
  UNION ALL SELECT x.id, 2, x.n / (SELECT max(n) FROM second) FROM (SELECT unnest(added) AS x FROM fin))""")
@_view("blast_radius_deep_edges", f"""{_DEEP_FILE} SELECT source, target, CAST(n AS DOUBLE) AS weight, 'high' AS confidence FROM (SELECT {_P} AS source, id AS target, n FROM near
  UNION ALL SELECT x.source, x.target, x.n FROM (SELECT unnest(edges) AS x FROM fin))""")
def _blast_deep(g):
    return views.blast_radius(g, _path(g), min_count=1, limit=50)


_DEEP_CALLS = f""", near AS (SELECT * FROM (SELECT callee_id AS id, call_count AS n, 0 AS side FROM calls WHERE caller_id = '{FUNCTION}' ORDER BY n DESC, id LIMIT 50) UNION ALL
    SELECT * FROM (SELECT caller_id, call_count, 1 FROM calls WHERE callee_id = '{FUNCTION}' ORDER BY 2 DESC, 1 LIMIT 50)),
  second AS (SELECT row_number() OVER (ORDER BY side, n DESC, via, id) AS i, * FROM (
    SELECT * FROM (SELECT 0 AS side, caller_id AS via, callee_id AS id, call_count AS n FROM calls WHERE caller_id IN (SELECT callee_id FROM calls WHERE caller_id = '{FUNCTION}')
      AND callee_id NOT IN (caller_id, '{FUNCTION}') ORDER BY n DESC, via, id LIMIT 100) UNION ALL
    SELECT * FROM (SELECT 1, callee_id AS via, caller_id AS id, call_count AS n FROM calls WHERE callee_id IN (SELECT caller_id FROM calls WHERE callee_id = '{FUNCTION}')
      AND caller_id NOT IN (callee_id, '{FUNCTION}') ORDER BY n DESC, via, id LIMIT 100)) WHERE EXISTS (SELECT 1 FROM near)), {_folded(f"'{FUNCTION}'", 101, 1, True)}"""


@_view("call_graph_deep_nodes", f"""{_DEEP_CALLS} SELECT id, 'Function' AS kind, name AS label, path || ' - ' || qualname AS subtitle, hop, round(w, 3) AS weight, {_PLAIN}, language AS "group" FROM (
  SELECT '{FUNCTION}' AS id, 0 AS hop, 1.0::DOUBLE AS w UNION ALL SELECT id, 1, arg_min(n, side) / (SELECT max(n) FROM near) FROM near GROUP BY id
  UNION ALL SELECT x.id, 2, x.n / (SELECT max(n) FROM second) FROM (SELECT unnest(added) AS x FROM fin)) JOIN function USING (id)""")
@_view("call_graph_deep_edges", f"""{_DEEP_CALLS} SELECT source, target, CAST(call_count AS DOUBLE) AS weight, confidence FROM (
  SELECT CASE WHEN side = 1 THEN id ELSE '{FUNCTION}' END AS source, CASE WHEN side = 1 THEN '{FUNCTION}' ELSE id END AS target FROM near
  UNION ALL SELECT x.source, x.target FROM (SELECT unnest(edges) AS x FROM fin)) JOIN calls ON caller_id = source AND callee_id = target""")
def _calls_deep(g):
    return views.call_graph(g, FUNCTION, limit=50)


_MAP = _hot() + _FEW.format(score="risk_score") + """, shown AS (SELECT path, risk_score, (SELECT count(DISTINCT author_email) FROM t WHERE t.path = few.path) = 1 AS alone,
  risk_score_recent > risk_score * 1.1 AS up FROM few)"""


@_view("repo_map_view_nodes", f"""{_MAP} SELECT path AS id, 'File' AS kind, string_split(path, '/')[-1] AS label, path || ' - risk ' || CAST(round(risk_score, 2) AS STRING)
  || CASE WHEN alone THEN ' - sole-owned' ELSE '' END || CASE WHEN up THEN ' - trending up' ELSE '' END AS subtitle, 1 AS hop, round(risk_score / max(risk_score) OVER (), 3) AS weight,
  alone AS sole_owned, up AS trending_worse, '' AS "group" FROM shown""", prepare=_with_hotspots)
def _repo_map(g):
    return views.repo_map_view(g)


@query(f"{_hot()}, x AS (SELECT path, hot.module, risk_score / max(risk_score) OVER () AS s FROM hot WHERE hot.module = 'Brand#11') SELECT path, CASE WHEN s >= 0.75 THEN 'critical' WHEN s >= 0.5 THEN 'serious' WHEN s >= 0.25 THEN 'warning' ELSE 'good' END AS tier FROM x")
def files_in_module(g):
    return client.in_module(hotspots.hotspots(g, AS_OF), "Brand#11").select("path", "tier")


@query(f"{_hot()} SELECT path, CASE WHEN s >= 0.75 THEN 'critical' WHEN s >= 0.5 THEN 'serious' WHEN s >= 0.25 THEN 'warning' ELSE 'good' END AS tier FROM (SELECT f.path, hot.risk_score / (SELECT max(risk_score) FROM hot) AS s FROM file f LEFT JOIN hot USING (path))")
def file_severity(g):
    return client.severity(g.file.select("path"), hotspots.hotspots(g, AS_OF))


@query(f"""SELECT id, list_sort(list(DISTINCT other)) AS neighbours FROM (SELECT caller_id AS id, callee_id AS other FROM calls WHERE caller_id IN (SELECT id FROM function WHERE is_method)
  AND callee_id IN (SELECT id FROM function WHERE is_method) UNION ALL SELECT callee_id, caller_id FROM calls WHERE caller_id IN (SELECT id FROM function WHERE is_method) AND callee_id IN (SELECT id FROM function WHERE is_method)) GROUP BY 1""")
def call_adjacency(g):
    edges = g.calls.select(F.col("caller_id").alias("source"), F.col("callee_id").alias("target"))
    return client.adjacency(client.known_edges(edges, g.function.where("is_method")))


# --- churn and risk


@query(f", {_HISTORY} SELECT id, change_count FROM hist")
def function_change_counts(g):
    return risk.change_history(g.function, g.hunks).select("id", "change_count")


@query(f", {_HISTORY} SELECT id, bug_fix_count FROM hist")
def function_bug_fix_counts(g):
    return risk.change_history(g.function, g.hunks).select("id", "bug_fix_count")


@query("SELECT callee_id, count(*) AS caller_count FROM calls GROUP BY 1")
def caller_counts(g):
    return callgraph.caller_counts(g.calls)


@query(f", {_HISTORY} SELECT id, risk_score FROM scored", prepare=_with_risk)
def function_risk(g):
    return g.function.select("id", "risk_score")


@query("SELECT DISTINCT h.hash, f.id, f.path FROM function f JOIN hunks h ON h.path = f.path AND h.lo <= f.end_line AND h.hi >= f.start_line")
def touched_functions(g):
    """Each commit as a set of changes."""
    return risk.touched_functions(g.function, g.hunks, by="hash").select("hash", "id", "path")


@query(f", {_HISTORY} SELECT round(quantile_cont(risk_score, 0.9), 6) AS threshold FROM scored WHERE risk_score > 0", prepare=_with_risk)
def risk_percentile(g):
    return risk.risk_percentile(g.function)


@query(f""", {_HISTORY} SELECT DISTINCT h.hash, f.id, f.risk_score, f.caller_count FROM scored f JOIN hunks h ON h.path = f.path AND h.lo <= f.end_line AND h.hi >= f.start_line
  WHERE (risk_score > 0 AND risk_score >= (SELECT quantile_cont(risk_score, 0.9) FROM scored WHERE risk_score > 0)) OR caller_count >= 100""", prepare=_with_risk)
def risk_flagged(g):
    return risk.flagged(g.function, g.hunks, min_callers=100, by="hash").select("hash", "id", "risk_score", "caller_count")


@query(f""", {_HISTORY}, r AS (SELECT rank() OVER (ORDER BY risk_score) + (count(*) OVER (PARTITION BY risk_score) - 1) / 2.0 AS rx,
  rank() OVER (ORDER BY bug_fix_count) + (count(*) OVER (PARTITION BY bug_fix_count) - 1) / 2.0 AS ry FROM scored JOIN hist USING (id))
  SELECT count(*) AS n, round(corr(rx, ry), 6) AS rho, CASE WHEN abs(corr(rx, ry)) < 0.1 THEN 'negligible' ELSE CASE WHEN abs(corr(rx, ry)) < 0.3 THEN 'weak' WHEN abs(corr(rx, ry)) < 0.5 THEN 'moderate'
  ELSE 'strong' END || CASE WHEN corr(rx, ry) < 0 THEN ' negative' ELSE ' positive' END END AS strength FROM r""", prepare=_with_risk)
def spearman(g):
    return risk.validate_risk(g.function, risk.change_history(g.function, g.hunks))


@query("SELECT hash, message LIKE 'fix:%' OR message LIKE 'bug %' AS is_fix FROM commit")
def bug_fix_messages(g):
    return g.commit.select("hash", is_bug_fix(F.col("message")).alias("is_fix"))


_oracles["call_dedupe"] = """SELECT caller_id, callee_id, CASE WHEN bool_or(h) THEN 'high' ELSE 'low' END AS confidence,
  arg_min(resolution, (CASE WHEN h THEN 0 ELSE 1 END) * 1000000000 + pos) AS resolution, count(*) AS call_count, list(line ORDER BY pos)[1:20] AS call_lines
  FROM (SELECT 'p' || CAST(l_partkey % 20 AS STRING) AS caller_id, 's' || CAST(l_suppkey % 20 AS STRING) AS callee_id, l_linenumber % 2 = 0 AS h,
  l_returnflag || l_linestatus AS resolution, l_linenumber AS line, l_orderkey * 10 + l_linenumber AS pos FROM lineitem) GROUP BY 1, 2"""


def _call_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Call sites made of order lines, folded into one row per pair."""
    sites = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.concat(F.lit("p"), F.col("l_partkey") % 20).alias("caller_id"),
        F.concat(F.lit("s"), F.col("l_suppkey") % 20).alias("callee_id"),
        F.when(F.col("l_linenumber") % 2 == 0, "high").otherwise("low").alias("confidence"),
        F.concat("l_returnflag", "l_linestatus").alias("resolution"),
        F.col("l_linenumber").alias("line"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
    )
    return callgraph.dedupe_calls(sites)


_queries["call_dedupe"] = _call_dedupe


# --- sources, resolution and streams, over texts and rows made of the tables


def table_query(sql: str):
    """Registers a function of (spark, sf_dir) under its name, with its SQL over the tables themselves."""

    def registered(f: Query) -> Query:
        _queries[f.__name__], _oracles[f.__name__] = f, sql
        return f

    return registered


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits parsed from log text with a block for each order; every third line of an order is a rename."""
    entry = F.expr("""concat(cast(l_quantity as int), '\t', l_linenumber, '\t', case when l_linenumber % 3 = 0
        then concat('\\0', 'old/', l_partkey, '\\0', 'src/', l_partkey) else concat('src/', l_partkey) end, '\\0')""")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", entry.alias("e")))), lambda x: x["e"]), "")
    lines = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(body.alias("body"))
    orders = _read(spark, sf_dir, "orders").join(lines, "o_orderkey")
    head = F.concat_ws(gitlog.UNIT, F.col("o_orderkey").cast("string"), F.concat(F.lit("c"), F.col("o_custkey") % 50), F.lit(""),
                       F.col("o_orderdate").cast("string"), "o_orderpriority")
    blocks = orders.select(F.col("o_orderkey").alias("log_pos"), F.concat(head, F.lit("\n"), "body").alias("block"))
    return gitlog.parse_log(blocks)


def _log(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return gitlog.tables(_commits(spark, sf_dir))


@table_query("""SELECT CAST(o_orderkey AS STRING) AS hash, 'c' || CAST(o_custkey % 50 AS STRING) || '@unknown.local' AS author_email, o_orderpriority AS message,
  a AS additions, d AS deletions, n AS files_changed FROM orders JOIN (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS a,
  CAST(sum(l_linenumber) AS BIGINT) AS d, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def gitlog_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir)["commit"].select("hash", "author_email", "message", "additions", "deletions", "files_changed")


@table_query("""SELECT CAST(l_orderkey AS STRING) AS hash, 'src/' || CAST(l_partkey AS STRING) AS path, CAST(arg_max(CAST(l_quantity AS INT), {'l': l_linenumber, 'q': CAST(CAST(l_quantity AS INT) AS VARCHAR)}) AS BIGINT) AS additions,
  CAST(max(l_linenumber) AS BIGINT) AS deletions, CASE WHEN max(l_linenumber) % 3 = 0 THEN 'R' ELSE 'M' END AS change_type
  FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey, l_partkey""")
def gitlog_modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir)["modified"]


@table_query("""SELECT path, '' AS extension, split_part(path, '/', 1) AS module, path LIKE 'src/%' AND p IN (SELECT l_partkey FROM lineitem WHERE l_linenumber % 3 = 0) AS has_rename_history
  FROM (SELECT DISTINCT 'src/' || CAST(l_partkey AS STRING) AS path, l_partkey AS p FROM lineitem
  UNION SELECT 'old/' || CAST(l_partkey AS STRING), l_partkey FROM lineitem WHERE l_linenumber % 3 = 0)""")
def gitlog_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir)["file"].select("path", "extension", "module", "has_rename_history")


@table_query("""SELECT DISTINCT 'old/' || CAST(l_partkey AS STRING) AS old_path, 'src/' || CAST(l_partkey AS STRING) AS new_path FROM lineitem WHERE l_linenumber % 3 = 0""")
def gitlog_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _log(spark, sf_dir)["renamed_to"]


@table_query("""SELECT 'd' || CAST(l_partkey % 40 AS STRING) AS path, 10 * l_linenumber AS lo, 10 * l_linenumber + CAST(l_quantity AS INT) - 1 AS hi FROM lineitem WHERE l_partkey % 40 <> 7""")
def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ranges parsed from one diff text for each order."""
    part = F.expr("""concat('diff --git a b\n--- a/x\n+++ ', case when l_partkey % 40 = 7 then '/dev/null' else concat('b/d', l_partkey % 40) end,
        '\n@@ -1,2 +', 10 * l_linenumber, ',', cast(l_quantity as int), ' @@ f()\n+x\n')""")
    texts = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(part), "").alias("text"))
    return diffs.diff_hunks(texts)


_SITES = """SELECT 'f' || CAST(l_partkey % 20 AS STRING) || '::c' || CAST(l_suppkey % 5 AS STRING) AS caller_id, 'f' || CAST(l_partkey % 20 AS STRING) AS path,
  CASE l_linenumber % 3 WHEN 0 THEN 'name' WHEN 1 THEN 'self_attr' ELSE 'name_attr' END AS kind, 'm' || CAST(l_suppkey % 7 AS STRING) AS base,
  'fn' || CAST(l_partkey % 90 AS STRING) AS name, l_linenumber AS line, l_orderkey * 10 + l_linenumber AS pos FROM {lineitem}"""
_NAMED = """SELECT 'f' || CAST(k % 20 AS STRING) AS path, 'fn' || CAST(k % 60 AS STRING) AS name, 'f' || CAST(k % 20 AS STRING) || '::x' || CAST(k AS STRING) AS id
  FROM (SELECT DISTINCT p_partkey % 75 AS k FROM {part}) x"""
_BOUND = """SELECT 'f' || CAST(p_partkey % 20 AS STRING) AS path, CASE WHEN p_partkey % 2 = 0 THEN 'm' || CAST(p_partkey % 7 AS STRING) ELSE 'fn' || CAST(p_partkey % 90 AS STRING) END AS local,
  'f' || CAST(p_partkey * 3 % 20 AS STRING) AS target, p_partkey AS pos FROM {part}"""
_PLAIN = {"lineitem": "lineitem", "part": "part"}


@table_query(f"""WITH s AS ({_SITES}), f AS ({_NAMED}), own AS (SELECT path, name, min(id) AS id FROM f GROUP BY 1, 2 HAVING count(*) = 1), every AS (SELECT name, min(id) AS id FROM f GROUP BY 1 HAVING count(*) = 1),
  b AS (SELECT path, local, arg_max(target, pos) AS target FROM ({_BOUND}) x GROUP BY 1, 2),
  r AS (SELECT s.*, CASE WHEN kind <> 'name_attr' THEN o.id END AS i1, CASE WHEN kind <> 'self_attr' THEN t.id END AS i2, e.id AS i3 FROM s LEFT JOIN own o ON o.path = s.path AND o.name = s.name
  LEFT JOIN b ON b.path = s.path AND b.local = CASE kind WHEN 'name' THEN s.name WHEN 'name_attr' THEN s.base END LEFT JOIN own t ON t.path = b.target AND t.name = s.name LEFT JOIN every e ON e.name = s.name)
  SELECT caller_id, coalesce(i1, i2, i3) AS callee_id, CASE WHEN i1 IS NULL AND i2 IS NULL THEN 'low' ELSE 'high' END AS confidence,
  CASE WHEN i1 IS NOT NULL THEN 'same_file' WHEN i2 IS NOT NULL THEN 'import_resolved' ELSE 'name_heuristic' END AS resolution, line, pos FROM r
  WHERE coalesce(i1, i2, i3) IS NOT NULL""".format(**_PLAIN))
def call_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What call sites made of order lines mean."""
    tables = {n: _read(spark, sf_dir, n) for n in _PLAIN}
    sites, named, bound = (spark.sql(q, **{n: t for n, t in tables.items() if f"{{{n}}}" in q}) for q in (_SITES, _NAMED, _BOUND))
    return resolve.resolve_calls(sites, named, bound)


@table_query("""SELECT 'p' || CAST(l_partkey % 40 AS STRING) AS path, CASE WHEN l_orderkey % 3 = 0 THEN 'fix it' ELSE 'work' END AS message, 5 * l_linenumber AS lo, 5 * l_linenumber + greatest(CAST(l_quantity AS INT), 1) - 1 AS hi FROM lineitem""")
def patch_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ranges of patch logs, a block for each order line."""
    block = F.expr("""concat(chr(1), case when l_orderkey % 3 = 0 then 'fix it' else 'work' end, '\n\ndiff --git a/p b/p\n--- a/p\n+++ b/p\n@@ -3,2 +', 5 * l_linenumber, ',', cast(l_quantity as int), ' @@ f\n+x\n')""")
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey") % 40, F.struct("l_orderkey", "l_linenumber", block.alias("b")).alias("b")).toDF("p", "b")
    log = F.array_join(F.transform(F.array_sort(F.collect_list("b")), lambda x: x["b"]), "").alias("log")
    return diffs.file_hunks(rows.groupBy(F.concat(F.lit("p"), F.col("p")).alias("path")).agg(log)).drop("commit_idx")


@table_query("""SELECT CAST(o_orderkey AS STRING) AS hash, 'c' || CAST(o_custkey % 50 AS STRING) AS author_name, 'c' || CAST(o_custkey % 50 AS STRING) || '@unknown.local' AS author_email,
  o_orderpriority AS message, a AS additions, d AS deletions, n AS files FROM orders JOIN (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS a, CAST(sum(l_linenumber) AS BIGINT) AS d,
  CAST(count(*) AS INT) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def load_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gitlog.load_records(_commits(spark, sf_dir))
    return rows.withColumn("files", F.size("files")).drop("timestamp")


#: A Python file for each part, with a method of p_size % 5 branches, and imports of two others.
_PYTHON = """SELECT 'pkg/m' || CAST(p_partkey AS STRING) || '.py' AS path, 'import pkg.m' || CAST(p_partkey * 7 % 50 + 1 AS STRING) || chr(10) || 'from .m' || CAST(p_partkey * 3 % 50 + 1 AS STRING) ||
  ' import f' || chr(10) || chr(10) || chr(10) || 'class K:' || chr(10) || '    def a(self, x):' || chr(10) || repeat('        if x and self:' || chr(10) || '            x = 1' || chr(10), CAST(p_size % 5 AS INT)) ||
  '        return self.b() + f(x) + p' || CAST(p_partkey % 300 AS STRING) || '()' || chr(10) || chr(10) || '    def b(self):' || chr(10) || '        return 0' || chr(10) || chr(10) || chr(10) || 'def ' ||
  CASE WHEN p_partkey % 2 = 0 THEN 'f' ELSE 'p' || CAST(p_partkey AS STRING) END || '(y):' || chr(10) || '    return [i for i in y if i]' || chr(10) AS source FROM {part}"""


def _python(spark: SparkSession, sf_dir: str, keep: bool = False) -> DataFrame:
    """What the files hold; kept where it is read more than once, as each time would parse anew."""
    sources = spark.sql(_PYTHON.format(part="{part}"), part=_read(spark, sf_dir, "part"))
    parsed = pysource.parse(sources)
    return written(parsed, "parsed-python") if keep else parsed


@table_query("""SELECT path || '::' || q AS id, first AS start_line, last AS end_line, m AS is_method, CAST(c AS INT) AS complexity FROM (SELECT 'pkg/m' || CAST(p_partkey AS STRING) || '.py' AS path,
  unnest([{'q': 'K.a', 'first': 6, 'last': 7 + 2 * (p_size % 5), 'm': true, 'c': 1 + 2 * (p_size % 5)}, {'q': 'K.b', 'first': 9 + 2 * (p_size % 5), 'last': 10 + 2 * (p_size % 5), 'm': true, 'c': 1},
  {'q': CASE WHEN p_partkey % 2 = 0 THEN 'f' ELSE 'p' || CAST(p_partkey AS STRING) END, 'first': 13 + 2 * (p_size % 5), 'last': 14 + 2 * (p_size % 5), 'm': false, 'c': 3}], recursive := true) FROM part)""")
def python_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _python(spark, sf_dir).select(F.inline("functions"))
    return found.select("id", "start_line", "end_line", "is_method", "complexity")


@table_query("""WITH e AS (SELECT 'pkg/m' || CAST(p_partkey AS STRING) || '.py' AS a, unnest([{'t': p_partkey * 7 % 50 + 1, 'n': 'pkg.m' || CAST(p_partkey * 7 % 50 + 1 AS STRING)},
  {'t': p_partkey * 3 % 50 + 1, 'n': 'f'}], recursive := true) FROM part) SELECT a AS from_path, 'pkg/m' || CAST(t AS STRING) || '.py' AS to_path, list_sort(list(DISTINCT n)) AS imported_names FROM e
  WHERE a <> 'pkg/m' || CAST(t AS STRING) || '.py' GROUP BY 1, 2""")
def python_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _python(spark, sf_dir, keep=True)
    return resolve.import_edges(resolve.resolve_imports(parsed.select(F.inline("bindings")), parsed.select("path")))


@table_query("""WITH p AS (SELECT p_partkey AS k, 'pkg/m' || CAST(p_partkey AS STRING) || '.py' AS path, 7 + 2 * (p_size % 5) AS line, p_partkey * 3 % 50 + 1 AS t FROM part)
  SELECT path || '::K.a' AS caller_id, path || '::K.b' AS callee_id, 'high' AS confidence, 'same_file' AS resolution, line FROM p
  UNION ALL SELECT path || '::K.a', CASE WHEN k % 2 = 0 THEN path ELSE 'pkg/m' || CAST(t AS STRING) || '.py' END || '::f', 'high', CASE WHEN k % 2 = 0 THEN 'same_file' ELSE 'import_resolved' END, line
  FROM p WHERE k % 2 = 0 OR t % 2 = 0
  UNION ALL SELECT path || '::K.a', 'pkg/m' || CAST(k % 300 AS STRING) || '.py::p' || CAST(k % 300 AS STRING), CASE WHEN k < 300 THEN 'high' ELSE 'low' END, CASE WHEN k < 300 THEN 'same_file' ELSE 'name_heuristic' END, line
  FROM p WHERE k % 300 % 2 = 1 AND k % 300 IN (SELECT k FROM p)""")
def python_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = _python(spark, sf_dir, keep=True)
    bound = resolve.resolve_imports(parsed.select(F.inline("bindings")), parsed.select("path"))
    return resolve.resolve_calls(parsed.select(F.inline("sites")), parsed.select(F.inline("functions")), bound).drop("pos")


@table_query("""WITH f AS (SELECT 'm' || CAST(p_partkey % 30 AS STRING) || '/n' || CAST(p_partkey % 90 AS STRING) AS s, count(*) AS n FROM part GROUP BY 1), e AS (SELECT replace(s, '/', '.') AS module, s FROM f
  UNION ALL SELECT split_part(s, '/', 2), s FROM f) SELECT module, min(s) || '.py' AS target FROM e GROUP BY 1 HAVING count(*) = 1""")
def module_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.expr("concat('m', p_partkey % 30, '/n', p_partkey % 90, '.py')").alias("path")
    return resolve.module_index(_read(spark, sf_dir, "part").select(path))


@table_query("SELECT p_partkey, list_reduce(list_transform(string_split('0' || p_name, ''), lambda c, i: CASE WHEN i = 1 THEN 0 ELSE unicode(c) END), lambda h, c: (h * 31 + c) % 4294967296) AS hash FROM part")
def name_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").select("p_partkey", client.string_hash(F.col("p_name")).alias("hash"))


#: A script for each part: an exported function with p_size % 4 branches that calls an imported one, and a class.
_SCRIPT = """SELECT 'src/s' || CAST(p_partkey AS STRING) || '.ts' AS path, 'import {{ g' || CAST(p_partkey * 3 % 50 + 1 AS STRING) || ' as h }} from "./s' || CAST(p_partkey * 3 % 50 + 1 AS STRING) || '.js";' || chr(10) ||
  'export function g' || CAST(p_partkey AS STRING) || '(a: (x: number) => void): {{ b: string }} {{' || chr(10) || repeat('  if (a && 1) {{ a(1); }}' || chr(10), CAST(p_size % 4 AS INT)) || '  return h(a);' || chr(10) || '}}' || chr(10) ||
  'class C {{' || chr(10) || '  run = (x) => x ? this.stop() : 0;' || chr(10) || '  stop() {{ return `}} ${{g' || CAST(p_partkey AS STRING) || '(1)}}`; }}' || chr(10) || '}}' || chr(10) AS source FROM {part}"""


def _scripts(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return tssource.analyze(spark.sql(_SCRIPT, part=_read(spark, sf_dir, "part")))


@table_query("""SELECT path || '::' || q AS id, CAST(first AS INT) AS start_line, CAST(last AS INT) AS end_line, e AS is_exported, m AS is_method, CAST(c AS INT) AS complexity FROM (SELECT 'src/s' || CAST(p_partkey AS STRING) || '.ts' AS path,
  unnest([{'q': 'g' || CAST(p_partkey AS STRING), 'first': 2, 'last': 4 + p_size % 4, 'e': true, 'm': false, 'c': 1 + 2 * (p_size % 4)}, {'q': 'C.run', 'first': 6 + p_size % 4, 'last': 6 + p_size % 4, 'e': false, 'm': false, 'c': 2},
  {'q': 'C.stop', 'first': 7 + p_size % 4, 'last': 7 + p_size % 4, 'e': false, 'm': true, 'c': 1}], recursive := true) FROM part)""")
def script_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scripts(spark, sf_dir)["functions"].select("id", "start_line", "end_line", "is_exported", "is_method", "complexity")


@table_query("""WITH p AS (SELECT p_partkey AS k, 'src/s' || CAST(p_partkey AS STRING) || '.ts' AS path, p_size % 4 AS n, p_partkey * 3 % 50 + 1 AS t FROM part)
  SELECT path || '::g' || CAST(k AS STRING) AS caller_id, 'src/s' || CAST(t AS STRING) || '.ts::g' || CAST(t AS STRING) AS callee_id, 'high' AS confidence, 'import_resolved' AS resolution, CAST(3 + n AS INT) AS line FROM p WHERE k <> t
  UNION ALL SELECT path || '::C.run', path || '::C.stop', 'high', 'same_file', CAST(6 + n AS INT) FROM p
  UNION ALL SELECT path || '::C.stop', path || '::g' || CAST(k AS STRING), 'high', 'same_file', CAST(7 + n AS INT) FROM p""")
def script_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scripts(spark, sf_dir)["calls"].drop("pos")


@table_query("""SELECT 'src/s' || CAST(p_partkey AS STRING) || '.ts' AS from_path, 'src/s' || CAST(p_partkey * 3 % 50 + 1 AS STRING) || '.ts' AS to_path, ['g' || CAST(p_partkey * 3 % 50 + 1 AS STRING)] AS imported_names
  FROM part WHERE p_partkey <> p_partkey * 3 % 50 + 1""")
def script_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scripts(spark, sf_dir)["imports"]


#: Parts as authors and orders as files: a graph in which most pairs are several files apart.
_ENDS = "(SELECT min(l_partkey) FROM lineitem)", "(SELECT max(l_partkey) FROM lineitem)"


@table_query(f"""WITH RECURSIVE e AS (SELECT DISTINCT a.l_partkey AS x, b.l_partkey AS y FROM lineitem a JOIN lineitem b USING (l_orderkey)),
  r(id, d) AS (SELECT {_ENDS[0]}, 0 UNION SELECT y, d + 1 FROM r JOIN e ON x = id WHERE d < 6 AND NOT EXISTS (SELECT 1 FROM r s WHERE s.id = {_ENDS[1]}))
  SELECT CAST(2 * min(d) AS INT) AS hops FROM r WHERE id = {_ENDS[1]} HAVING count(*) > 0""")
def part_path_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of the shortest path between the first and the last part over the orders that parts share."""
    lines = _read(spark, sf_dir, "lineitem")
    ends = lines.agg(F.min("l_partkey").cast("string"), F.max("l_partkey").cast("string")).first()
    touched = lines.select(F.col("l_partkey").cast("string").alias("email"), F.col("l_orderkey").cast("string").alias("path"))
    return paths.steps(touched, *ends).groupBy().agg(F.max("step").alias("hops")).where("hops is not null")


@table_query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return history.churn(events, "event_type").withColumn("start", F.col("start").cast("timestamp_ntz"))


@table_query("""SELECT min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", user_id, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = history.sessions(events, "user_id", "12 hours")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
