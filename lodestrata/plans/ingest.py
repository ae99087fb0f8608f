"""From a repository to its graph: history, functions, calls, churn and risk, and incremental updates of saved tables."""

from __future__ import annotations

import warnings
from dataclasses import replace
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension_of
from ..operators.callgraph import dedupe_calls, dedupe_imports
from ..operators.lineage import mark_deleted
from ..operators.resolve import import_edges, resolve_calls, resolve_imports
from ..operators.risk import change_history, with_risk
from ..runtime import written
from ..sources import diffs, gitlog, gitsource, pysource, tssource
from .graph import KEYS, RepoGraph, Settings
from .materialize import materialize


def history_graph(commits: DataFrame, live_paths: DataFrame | None = None, module_depth: int = 1, settings: Settings | None = None) -> RepoGraph:
    """The graph of parsed commits (sources.gitlog.parse_log); paths that are not live are marked as deleted."""
    tables = gitlog.tables(commits, module_depth)
    if live_paths is not None:
        tables["file"] = mark_deleted(tables["file"], live_paths)
    return RepoGraph(**tables, settings=settings or Settings())


def _python(sources: DataFrame) -> dict[str, DataFrame]:
    python = sources.where(extension_of(F.col("path")) == "py")
    parsed = written(pysource.parse(python), "parsed")
    functions, sites = parsed.select(F.inline("functions")), parsed.select(F.inline("sites"))
    bound = resolve_imports(parsed.select(F.inline("bindings")), python.select("path"))
    unread = parsed.where("reason is not null").select("path", "reason")
    return {"functions": functions, "calls": resolve_calls(sites, functions, bound), "imports": import_edges(bound), "unread": unread}


#: What reads the sources of each language, by extension; files of others are passed over.
LANGUAGES = {("py",): _python, tuple(tssource.EXTENSIONS): tssource.analyze}
EXTENSIONS = tuple(e for some in LANGUAGES for e in some)


def analyze(sources: DataFrame) -> dict[str, DataFrame]:
    """functions, calls and imports of sources (path, source) in all languages, and unread: path and reason of each file that was
    not read, or not as it is. A language that fails is left out with a warning, and all its files are listed."""
    found: dict[str, DataFrame] = {}
    unread = [sources.where("reason is not null").select("path", "reason")] if "reason" in sources.columns else []
    for extensions, read in LANGUAGES.items():
        own = sources.where(extension_of(F.col("path")).isin(*extensions))
        try:
            tables = {n: written(df, n) for n, df in read(own).items()}
        except PySparkException as e:
            warnings.warn(f"sources with the extensions {', '.join(extensions)} are left out: {e}", stacklevel=2)
            unread.append(own.select("path", F.lit(f"its language failed: {type(e).__name__}").alias("reason")))
            continue
        unread.append(tables.pop("unread"))
        found = {n: found[n].unionByName(df) if n in found else df for n, df in tables.items()}
    if not found:
        raise RuntimeError("no language could be read")
    return found | {"unread": reduce(DataFrame.unionByName, unread)}


def function_graph(g: RepoGraph, sources: DataFrame, hunks: DataFrame | None = None, more: dict[str, DataFrame] | None = None) -> RepoGraph:
    """g with functions, calls and imports of sources (path, source), and of more (sources.tsjson.read).

    hunks (path, hash, message, lo, hi) give change counts. Risk counts callers that are no functions too.
    """
    found = analyze(sources)
    if more:
        found = {n: df.unionByName(more[n].select(*df.columns)) if n in more else df for n, df in found.items()}
    functions, calls, imports = found["functions"], found["calls"], found["imports"]
    calls = written(dedupe_calls(calls), "calls")
    if hunks is None:
        hunks = functions.sparkSession.createDataFrame([], "path string, hash string, message string, lo int, hi int")
    functions = with_risk(functions, calls, change_history(functions, hunks))
    return replace(g, function=functions, calls=calls, imports=dedupe_imports(imports), hunks=hunks, unread=found["unread"])


#: What an ingest takes at most, and the schemes of public repositories.
MAX_COMMITS, SCHEMES = 5000, ("http://", "https://")


def validated(repo_url: str, max_commits: int = MAX_COMMITS) -> tuple[str, int]:
    """A request's address and number of commits: white space is cut off, the number brought into its bounds. ValueError for what is no
    public address."""
    url = repo_url.strip()
    if not url.startswith(SCHEMES):
        raise ValueError(f"a public repository's address begins with {' or '.join(SCHEMES)}")
    return url, min(max(max_commits, 1), MAX_COMMITS)


def ingest(spark: SparkSession, repo: str, as_of: str, max_commits: int = 5000, module_depth: int = 1, settings: Settings | None = None) -> RepoGraph:
    """The whole graph of a repository with its derived tables. Log, listing, patches and sources are
    read by the executors, for all of which the repository is under the same path; what fails in the function graph leaves the history graph whole."""
    gitsource.git(repo, "rev-parse", "HEAD")  # a GitError here, where there is no history, rather than in a task
    gitsource.register(spark)
    log = spark.read.format("git_log").option("path", repo).option("maxCommits", max_commits).load()
    commits = written(gitlog.parse_log(log), "commits")
    try:
        live = written(spark.read.format("git_tree").option("path", repo).load(), "live-paths")
    except PySparkException as e:
        warnings.warn(f"no listing of live files: {e}", stacklevel=2)
        live = None
    g = history_graph(commits, live, module_depth, settings)
    if live is not None:
        sources = pysource.with_empty(pysource.scan(spark, repo, EXTENSIONS), live, EXTENSIONS).join(live, "path", "left_semi")
        logs = written(diffs.patch_logs(spark, repo, sources.select("path")), "patches")
        hunks = diffs.file_hunks(logs).withColumn("hash", F.concat("path", F.lit("#"), "commit_idx"))
        g = function_graph(g, sources, hunks.drop("commit_idx"))
        g = replace(g, unread=written(g.unread.unionByName(logs.where("reason is not null").select("path", "reason")), "unread"))
    return materialize(g, as_of)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new over old: rows of old whose keys new has are replaced; within new the keys must be unique."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def update(g: RepoGraph, more: RepoGraph, as_of: str) -> RepoGraph:
    """g with another batch of history; derived tables are made anew, so that nothing stale stays."""
    names = ("author", "commit", "modified", "renamed_to", "file")
    tables = {n: written(upsert(getattr(g, n), getattr(more, n), KEYS[n]), n) for n in names}
    return materialize(replace(g, **tables), as_of)
