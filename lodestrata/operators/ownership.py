"""Who owns what: shares, author statistics, criticality, connections and team topology."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import contains_ci, is_stale
from ..runtime import spread
from .lineage import on_lineage

if TYPE_CHECKING:
    from ..plans.graph import RepoGraph


def author_files(g: RepoGraph) -> DataFrame:
    """email, path, commits: distinct commits of each author on each path; what most operators here begin with.

    Rows are dealt by path once, which serves what is grouped by path behind it too.
    """
    return spread(g.touches.select("author_email", "path", "hash"), "path").groupBy(F.col("author_email").alias("email"), "path").agg(F.countDistinct("hash").alias("commits"))


def file_owners(g: RepoGraph, path: str, limit: int = 10) -> DataFrame:
    """author_name, author_email, commit_count, share over a file's lineage; shares are of all owners, before the limit."""
    counts = (
        on_lineage(g, path, g.touches)
        .groupBy(F.col("author_email").alias("email"))
        .agg(F.countDistinct("hash").alias("commit_count"))
    )
    total = counts.agg(F.sum("commit_count").alias("total"))
    return (
        counts.join(g.author, "email")
        .crossJoin(F.broadcast(total))  # one row
        .select(F.col("name").alias("author_name"), F.col("email").alias("author_email"), "commit_count", (F.col("commit_count") / F.col("total")).alias("share"))
        .orderBy(F.desc("commit_count"), "author_email")
        .limit(limit)
    )


def author_stats(g: RepoGraph, authors: DataFrame | None = None) -> DataFrame:
    """email, name, commit_count, file_count, first_ts, last_ts of authors with commits; timestamps compare as text."""
    authors = g.author if authors is None else authors
    mine = g.commit.select("hash", F.col("author_email").alias("email"), "timestamp").join(authors.select("email"), "email", "left_semi")
    commits = mine.groupBy("email").agg(
        F.count("*").alias("commit_count"), F.min("timestamp").alias("first_ts"), F.max("timestamp").alias("last_ts")
    )
    files = mine.join(g.modified.select("hash", "path"), "hash").groupBy("email").agg(F.countDistinct("path").alias("file_count"))
    return (
        commits.join(files, "email", "left")
        .join(authors.select("email", "name"), "email")
        .select("email", "name", "commit_count", F.coalesce("file_count", F.lit(0)).alias("file_count"), "first_ts", "last_ts")
    )


def author_list(g: RepoGraph, search: str = "", limit: int = 30, offset: int = 0) -> DataFrame:
    """Authors by commits. Without a search the materialized table serves, if there is one; names are filtered first."""
    if not search and g.author_stats is not None:
        found = g.author_stats.where(F.col("commit_count").isNotNull())
    else:
        found = author_stats(g, g.author.where(contains_ci(F.col("name"), search)))
    return found.orderBy(F.desc("commit_count"), "email").offset(offset).limit(limit)


def author_detail(g: RepoGraph, email: str) -> DataFrame:
    """One row of author_stats; none for an unknown author."""
    return author_stats(g, g.author.where(F.col("email") == email))


def author_top_files(g: RepoGraph, email: str, limit: int = 10) -> DataFrame:
    mine = g.touches.where(F.col("author_email") == email).groupBy("path").agg(F.count("*").alias("commit_count"))
    found = mine.join(g.file.select("path", "module"), "path").select("path", "module", "commit_count")
    return found.orderBy(F.desc("commit_count"), "path").limit(limit)


def author_top_modules(g: RepoGraph, email: str, limit: int = 8) -> DataFrame:
    mine = g.touches.where(F.col("author_email") == email).join(g.file.select("path", "module"), "path")
    found = mine.groupBy(F.col("module").alias("name")).agg(F.count("*").alias("touches"))
    return found.orderBy(F.desc("touches"), "name").limit(limit)


def criticality(
    g: RepoGraph, concentration: float | None = None, boost: float | None = None, baseline: float | None = None
) -> DataFrame:
    """email, name, criticality_score, sole_owned_file_count of authors that hold a share of at least concentration of a
    live file's commits (own path). Needs file_hotspot; files without a score count 0."""
    s = g.settings
    least, more, base = (x if x is not None else d for x, d in ((concentration, s.concentration), (boost, s.sole_boost), (baseline, s.sole_baseline)))
    # a commit has one author, so a file's commits are the sum of its authors' commits
    shares = author_files(g).withColumn("share", F.col("commits") / F.sum("commits").over(Window.partitionBy("path")))
    held = shares.where(F.col("share") >= least).join(g.live_files.select("path"), "path", "left_semi")
    risk = F.coalesce("risk_score", F.lit(0.0))
    alone = F.col("share") == 1.0
    part = risk * F.col("share") * F.when(alone, 1 + more).otherwise(1.0) + F.when(alone, base).otherwise(0.0)
    return (
        held.join(g.file_hotspot.select("path", "risk_score"), "path", "left")
        .groupBy("email")
        .agg(F.sum(part).alias("criticality_score"), F.count_if(alone).alias("sole_owned_file_count"))
        .join(g.author.select("email", "name"), "email")
        .select("email", "name", "criticality_score", "sole_owned_file_count")
    )


def critical_authors(g: RepoGraph, as_of: str, limit: int = 20) -> DataFrame:
    """The materialized criticality, highest first, with last_commit_at and is_stale."""
    last = g.author_stats.select("email", F.col("last_ts").alias("last_commit_at"))
    found = g.author_criticality.join(last, "email", "left").orderBy(F.desc("criticality_score"), "email").limit(limit)
    return found.withColumn("is_stale", is_stale(F.col("last_commit_at").cast("timestamp"), as_of, g.settings.stale_days))


def direct_connection(g: RepoGraph, email_a: str, email_b: str) -> DataFrame:
    """a1_email, a1_name, file_path, a2_email, a2_name: the first file by path that both authors touched."""
    own = g.touches.where(F.col("author_email").isin(email_a, email_b)).select("author_email", "path", "hash")
    both = own.groupBy("path").agg(F.countDistinct("author_email").alias("n")).where("n = 2")
    names = [g.author.where(F.col("email") == e).select(F.col("email").alias(f"a{i}_email"), F.col("name").alias(f"a{i}_name")) for i, e in ((1, email_a), (2, email_b))]
    first = both.orderBy("path").limit(1).select(F.col("path").alias("file_path"))
    return first.crossJoin(names[0]).crossJoin(names[1]).select("a1_email", "a1_name", "file_path", "a2_email", "a2_name")  # one row each


def bridge_connection(g: RepoGraph, email_a: str, email_b: str) -> DataFrame:
    """The first chain, by bridge, first and second path: author, file, bridge, file, author."""
    pairs = g.touches.select(F.col("author_email").alias("email"), "path").distinct()
    a = pairs.where(F.col("email") == email_a).select(F.col("path").alias("file_path_1"))
    b = pairs.where(F.col("email") == email_b).select(F.col("path").alias("file_path_2"))
    third = pairs.where(~F.col("email").isin(email_a, email_b)).withColumnRenamed("email", "bridge_email")
    one = third.join(a, F.col("path") == F.col("file_path_1")).groupBy("bridge_email").agg(F.min("file_path_1").alias("file_path_1"))
    two = third.join(b, F.col("path") == F.col("file_path_2")).groupBy("bridge_email").agg(F.min("file_path_2").alias("file_path_2"))
    chain = one.join(two, "bridge_email").orderBy("bridge_email").limit(1)
    name = lambda c: g.author.select(F.col("email").alias(f"{c}_email"), F.col("name").alias(f"{c}_name"))
    chain = chain.withColumns({"a1_email": F.lit(email_a), "a2_email": F.lit(email_b)})
    for c in ("a1", "a2", "bridge"):
        chain = chain.join(name(c), f"{c}_email")
    return chain.select("a1_email", "a1_name", "file_path_1", "bridge_email", "bridge_name", "file_path_2", "a2_email", "a2_name")


def author_path(g: RepoGraph, email_a: str, email_b: str) -> dict:
    """found, hops (2 or 4) and steps: (kind, id) from one author to the other; the longer tier runs only if needed."""
    if email_a == email_b:
        raise ValueError("two different authors are needed")
    if row := direct_connection(g, email_a, email_b).first():
        steps = [("Author", row.a1_email), ("File", row.file_path), ("Author", row.a2_email)]
    elif row := bridge_connection(g, email_a, email_b).first():
        steps = [("Author", row.a1_email), ("File", row.file_path_1), ("Author", row.bridge_email), ("File", row.file_path_2), ("Author", row.a2_email)]
    else:
        return {"found": False, "hops": 0, "steps": []}
    return {"found": True, "hops": len(steps) - 1, "steps": steps}


def author_network(g: RepoGraph, email: str, min_shared: int = 1, limit: int = 15, anchors: int | None = None) -> DataFrame:
    """email, name, shared_files of others on the author's most touched live files, of which at most anchors count."""
    mine = author_files(g).where(F.col("email") == email).join(g.live_files.select("path"), "path", "left_semi")
    few = mine.orderBy(F.desc("commits"), "path").limit(g.settings.anchor_files if anchors is None else anchors).select("path")
    others = g.touches.join(few, "path", "left_semi").where(F.col("author_email") != email)
    found = others.groupBy(F.col("author_email").alias("email")).agg(F.countDistinct("path").alias("shared_files"))
    found = found.where(F.col("shared_files") >= min_shared).join(g.author, "email").select("email", "name", "shared_files")
    return found.orderBy(F.desc("shared_files"), "email").limit(limit)


def sole_owned(g: RepoGraph, files: DataFrame) -> DataFrame:
    """path of those files that exactly one author has touched (own path)."""
    touched = spread(g.touches.select("author_email", "path"), "path")
    owners = touched.join(files.select("path").distinct(), "path", "left_semi").groupBy("path")
    return owners.agg(F.countDistinct("author_email").alias("n")).where("n = 1").select("path")


def author_sole_owned_files(g: RepoGraph, email: str, limit: int = 15) -> DataFrame:
    """path, module, commit_count, last_touched of live files that only this author has touched."""
    mine = g.touches.where(F.col("author_email") == email).select("path").distinct()
    touched = spread(g.touches.select("author_email", "path", "hash", "timestamp"), "path")
    per = touched.join(mine, "path", "left_semi").groupBy("path").agg(
        F.min("author_email").alias("low"), F.max("author_email").alias("high"),
        F.countDistinct("hash").alias("commit_count"), F.max("timestamp").alias("last_touched"),
    )
    own = per.where((F.col("low") == email) & (F.col("high") == email))
    found = own.join(g.live_files.select("path", "module"), "path").select("path", "module", "commit_count", "last_touched")
    return found.orderBy(F.desc("commit_count"), "path").limit(limit)


def primary_modules(g: RepoGraph, authors: DataFrame) -> DataFrame:
    """email, primary_module: where each author has most distinct commits; ties by name."""
    mine = g.touches.join(authors.select(F.col("email").alias("author_email")), "author_email", "left_semi")
    touched = spread(mine.select("author_email", "path", "hash"), "path").join(g.file.select("path", "module"), "path").groupBy(F.col("author_email").alias("email"), "module")
    counts = touched.agg(F.countDistinct("hash").alias("touches"))
    first = F.min(F.struct((-F.col("touches")).alias("k"), "module"))
    return counts.groupBy("email").agg(first["module"].alias("primary_module"))


def shared_file_pairs(g: RepoGraph, authors: DataFrame, min_touches: int = 2, max_authors: int = 8, limit: int = 120) -> DataFrame:
    """email_a, email_b, shared_files over live files that 2 to max_authors of the authors touched min_touches times.

    The degree limit bounds what the self-join by file can multiply.
    """
    mine = author_files(g).join(authors.select("email"), "email", "left_semi").where(F.col("commits") >= min_touches)
    mine = mine.join(g.live_files.select("path"), "path", "left_semi").select("path", "email")
    usual = mine.groupBy("path").count().where(f"count between 2 and {max_authors}").select("path")
    few = mine.join(usual, "path")
    a, b = few.withColumnRenamed("email", "email_a"), few.withColumnRenamed("email", "email_b")
    found = a.join(b, "path").where("email_a < email_b").groupBy("email_a", "email_b").agg(F.count("*").alias("shared_files"))
    return found.orderBy(F.desc("shared_files"), "email_a", "email_b").limit(limit)


def topology_nodes(g: RepoGraph, top_n: int = 40) -> DataFrame:
    """email, name, commit_count, weight, primary_module of the authors with most commits."""
    few = author_list(g, limit=top_n)
    most = few.agg(F.max("commit_count").alias("most"))
    return few.crossJoin(F.broadcast(most)).join(primary_modules(g, few), "email", "left").select(  # one row
        "email", "name", "commit_count", F.round(F.col("commit_count") / F.col("most"), 3).alias("weight"), "primary_module"
    )
