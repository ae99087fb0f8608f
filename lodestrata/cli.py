"""Command line: python -m lodestrata ... prints one JSON document; errors are {"error": ...} with exit status 1."""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import callgraph, risk, views
from .plans import graph, ingest
from .sources import diffs, gitlog

FOLDER = ".lodestrata"


def is_url(target: str) -> bool:
    """Whether target names a repository elsewhere: by its scheme, by user@host:path, or by its last letters."""
    low = target.lower()
    return urlsplit(low).scheme in ("http", "https", "ssh") or low.partition(":")[0].startswith("git@") or low.endswith(".git")


def find_store(start: str = ".") -> str | None:
    """The nearest store in start or a folder above it."""
    here = Path(start).resolve()
    return next((str(p / FOLDER) for p in (here, *here.parents) if (p / FOLDER).is_dir()), None)


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lodestrata")
    parser.add_argument("--store", help="folder of the tables; else the nearest one above")
    commands = parser.add_subparsers(dest="command", required=True)
    add = commands.add_parser
    p = add("ingest")
    p.add_argument("target")
    p.add_argument("--max-commits", type=int, default=5000)
    p.add_argument("--module-depth", type=int, default=1)
    p.add_argument("--as-of", required=True)
    p = add("search")
    p.add_argument("q")
    p.add_argument("--limit", type=int, default=50)
    for name in ("function", "callers", "callees"):
        add(name).add_argument("id")
    add("risk").add_argument("path")
    p = add("blast-radius")
    p.add_argument("id")
    p.add_argument("--depth", type=int, choices=(1, 2), default=1)
    p = add("check-diff")
    p.add_argument("diff")
    p.add_argument("--percentile", type=float, default=90)
    p.add_argument("--min-callers", type=int, default=5)
    p.add_argument("--markdown")
    return parser


def _answer(spark: SparkSession, args: argparse.Namespace) -> dict | list:
    if args.command == "ingest":
        repo = gitlog.clone(args.target, tempfile.mkdtemp()) if is_url(args.target) else args.target
        store = args.store or str(Path(repo if not is_url(args.target) else ".") / FOLDER)
        g = ingest.ingest(spark, repo, args.as_of, args.max_commits, args.module_depth)
        graph.save(g, store)
        counts = {"files": g.file.count(), "commits": g.commit.count(), "functions": g.function.count() if g.function else 0}
        unread = _rows(g.unread.groupBy("reason").count().orderBy(F.desc("count"), "reason").limit(20)) if g.unread else []
        return {"store": store, **counts, "unread": unread}
    store = args.store or find_store()
    if store is None:
        raise LookupError("no store here or above; run ingest first")
    g = graph.load(spark, store)
    if args.command == "search":
        return _rows(callgraph.functions_list(g, args.q, "risk", args.limit))
    if args.command in ("callers", "callees"):
        return _rows(callgraph.neighbours(g, args.id, args.command))
    if args.command == "function":
        found = _rows(callgraph.function_detail(g, args.id))
        if not found:
            raise LookupError(f"no function {args.id}")
        return found[0] | {d: _rows(callgraph.neighbours(g, args.id, d)) for d in ("callers", "callees")}
    if args.command == "risk":
        found = _rows(callgraph.with_counts(g, g.function.where(g.function.path == args.path)).orderBy("risk_score", ascending=False))
        if not found:
            raise LookupError(f"no functions in {args.path}")
        return found
    if args.command == "blast-radius":
        view = views.call_blast_radius(g, args.id, args.depth)
        if view is None:
            raise LookupError(f"no function {args.id}")
        return view.dict()
    hunks = diffs.diff_hunks(spark.createDataFrame([(Path(args.diff).read_text(),)], "text string"))
    flags = risk.flagged(g.function, hunks, args.percentile, args.min_callers)
    text = risk.markdown(flags)
    if args.markdown and text:
        Path(args.markdown).write_text(text)
    return _rows(flags.drop("source"))


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("lodestrata").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        print(json.dumps(_answer(spark, args), default=str))
    except (LookupError, gitlog.GitError, OSError) as e:
        print(json.dumps({"error": str(e)}))
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
