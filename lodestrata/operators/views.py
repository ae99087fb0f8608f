"""Response graphs: blast radii, call graphs, collaboration, topology and maps, as tables of nodes and edges.

Every graph is a plan: nodes and edges come from joins and aggregates of rows that are limited before. Which second-degree nodes of a
radius are shown depends on the order in which its rows are taken; these, at most some tens by their limits, are folded in their
order within one row. Only what a command line or a response needs as lists is collected, when it is asked for.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from functools import cached_property
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import callgraph, coupling, hotspots, ownership
from .callgraph import BRIEF, neighbours, second_neighbours
from .coupling import blast_radius_direct, blast_radius_transitive

if TYPE_CHECKING:
    from ..plans.graph import RepoGraph

#: What a node has if nothing else is said.
NODE = {"kind": "", "label": "", "subtitle": "", "hop": 0, "weight": 1.0, "sole_owned": False, "trending_worse": False, "group": ""}
NODES = "id string, kind string, label string, subtitle string, hop int, weight double, sole_owned boolean, trending_worse boolean, group string"
EDGES = "source string, target string, weight double, confidence string"
_DESCRIBED = "id string, kind string, label string, subtitle string, `group` string"


def node_rows(rows: DataFrame, **columns: Column | str | int | float) -> DataFrame:
    """rows as nodes: id and what else is given, the rest as in NODE. Row order is kept in `at`, if rows have it."""
    given = {k: v if isinstance(v, Column) else F.lit(v) for k, v in ({k: F.lit(v) for k, v in NODE.items()} | columns).items()}
    at = [F.col("at")] if "at" in rows.columns else []
    names = [c.split()[0] for c in NODES.split(", ")]
    kinds = {c.split()[0]: c.split()[1] for c in NODES.split(", ")}
    return rows.select(*[given[n].cast(kinds[n]).alias(n) for n in names], *at)


def edge_rows(rows: DataFrame, source: str, target: str, weight: str, confidence: Column | None = None) -> DataFrame:
    sure = F.lit("high") if confidence is None else F.coalesce(confidence, F.lit("high"))
    at = [F.col("at")] if "at" in rows.columns else []
    return rows.select(F.col(source).alias("source"), F.col(target).alias("target"), F.col(weight).cast("double").alias("weight"), sure.alias("confidence"), *at)


def placed(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows, which are few by a limit, with their number `at` in an order."""
    return rows.withColumn("at", F.row_number().over(Window.orderBy(*order)))


@dataclass
class GraphView:
    """A graph as tables; nodes, edges and truncated are collected when they are asked for."""

    root: str
    node_table: DataFrame
    edge_table: DataFrame
    truncated_table: DataFrame | None = None
    more: dict[str, DataFrame] = field(default_factory=dict)

    def frames(self, spark=None) -> tuple[DataFrame, DataFrame]:
        return self.node_table.drop("at"), self.edge_table.drop("at")

    @staticmethod
    def _listed(df: DataFrame) -> list[dict]:
        rows = [r.asDict() for r in df.collect()]
        rows.sort(key=lambda r: r.get("at") or 0)
        return [{k: v for k, v in r.items() if k != "at"} for r in rows]

    @cached_property
    def nodes(self) -> list[dict]:
        return self._listed(self.node_table)

    @cached_property
    def edges(self) -> list[dict]:
        return self._listed(self.edge_table)

    @cached_property
    def truncated(self) -> bool:
        return self.truncated_table is not None and bool(self.truncated_table.first()[0])

    def dict(self) -> dict:
        more = {k: self._listed(df) for k, df in self.more.items()}
        return {"root": self.root, "nodes": self.nodes, "edges": self.edges, "truncated": self.truncated} | more


def _described(rows: DataFrame, n: str) -> dict[str, Column]:
    """id, kind, label, subtitle, group of files (path) or functions."""
    if "qualname" in rows.columns:
        said = F.concat("path", F.lit(" - "), "qualname")
        return {"id": F.col("id"), "kind": F.lit("Function"), "label": F.col("name"), "subtitle": said, "group": F.coalesce("language", F.lit(""))}
    return {"id": F.col("path"), "kind": F.lit("File"), "label": F.element_at(F.split("path", "/"), -1), "subtitle": F.col("path"), "group": F.lit("")}


_ROW = f"struct<at:int,side:int,via:string,n:bigint,confidence:string,{','.join(c.replace(' ', ':') for c in _DESCRIBED.split(', '))}>"


def _listed_rows(parts: list[tuple[DataFrame, str, list[Column | str]]], root: str) -> DataFrame:
    """One row with `rows`: the rows of the parts in the order of the parts and their own. via is root in rows without one."""
    out = None
    for side, (rows, n, order) in enumerate(parts):
        described = _described(rows, n)
        via = F.col("via") if "via" in rows.columns else F.lit(root)
        sure = F.coalesce("confidence", F.lit("high")) if "confidence" in rows.columns else F.lit("high")
        count = F.when(F.coalesce(F.col(n), F.lit(0)) == 0, 1).otherwise(F.col(n))
        struct = F.struct(F.col("at").cast("int"), F.lit(side).alias("side"), via.alias("via"), count.cast("bigint").alias("n"), sure.alias("confidence"),
                          *[c.alias(k) for k, c in described.items()])
        part = placed(rows, *order).select(F.lit(side).alias("side"), "at", struct.cast(_ROW).alias("row"))
        out = part if out is None else out.union(part)
    return out.agg(F.transform(F.array_sort(F.collect_list(F.struct("side", "at", "row"))), lambda x: x["row"]).alias("rows"))


def _radius(root: str, about: DataFrame, first, second, most: int, directed: bool, turned: int | None) -> GraphView:
    """The root (one row of about), its neighbours (first) and theirs (second, or None), of each at most some tens of rows.

    Neighbours are all shown. Of second rows those are passed over whose via is not shown; a node beyond most nodes ends its part. A
    pair has one edge. Rows of the part numbered turned point to their via, others from it. Weights are against the greatest
    count of a degree.
    """
    one = F.struct(*[c.alias(k) for k, c in _described(about, "").items()])
    rows = about.limit(1).select(one.alias("root")).crossJoin(_listed_rows(first, root).withColumnRenamed("rows", "first"))  # one row each
    rows = rows.crossJoin(_listed_rows(second, root).withColumnRenamed("rows", "second")) if second else rows.withColumn("second", F.lit(None).cast(f"array<{_ROW}>"))
    second_rows = F.when(F.size("first") > 0, F.coalesce("second", F.array().cast(f"array<{_ROW}>"))).otherwise(F.array().cast(f"array<{_ROW}>"))
    node = f"struct<{','.join(c.replace(' ', ':') for c in NODES.replace('group', '`group`').split(', '))}>"
    edge = f"struct<{','.join(c.replace(' ', ':') for c in EDGES.split(', '))}>"
    state = f"struct<seen:array<string>,nodes:array<{node}>,pairs:array<string>,edges:array<{edge}>,ended:array<int>,truncated:boolean>"

    def shown(r: Column, hop: int, weight: Column) -> Column:
        return F.struct(r["id"], r["kind"], r["label"], r["subtitle"], F.lit(hop), weight, F.lit(False), F.lit(False), r["group"]).cast(node)

    def step(hop: int, greatest: Column):
        def taken(s: Column, r: Column) -> Column:
            known, reached = F.array_contains(s["seen"], r["id"]), F.array_contains(s["seen"], r["via"]) & ~F.array_contains(s["ended"], r["side"])
            full = F.lit(hop == 2) & (F.size(s["nodes"]) >= most)
            new, ends = reached & ~known & ~full, reached & ~known & full
            turn = r["side"] == (turned if turned is not None else -1)
            source, target = F.when(turn, r["id"]).otherwise(r["via"]), F.when(turn, r["via"]).otherwise(r["id"])
            ordered = [source, target] if directed else [F.least(source, target), F.greatest(source, target)]
            pair = F.to_json(F.array(*ordered))
            drawn = reached & ~ends & ~F.array_contains(s["pairs"], pair)
            more = lambda c, on, x: F.when(on, F.concat(s[c], F.array(x))).otherwise(s[c])
            return F.struct(
                more("seen", new, r["id"]).alias("seen"),
                more("nodes", new, shown(r, hop, F.round(r["n"] / greatest, 3))).alias("nodes"),
                more("pairs", drawn, pair).alias("pairs"),
                more("edges", drawn, F.struct(source, target, r["n"].cast("double"), r["confidence"]).cast(edge)).alias("edges"),
                more("ended", ends, r["side"]).alias("ended"),
                (s["truncated"] | ends).alias("truncated"),
            ).cast(state)

        return taken

    greatest = lambda c: F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(c, lambda r: r["n"])), F.lit(1)))
    rows = rows.withColumn("second", second_rows).withColumns({"m1": greatest("first"), "m2": greatest("second")})
    start = F.struct(F.array(F.lit(root)), F.array(shown(F.col("root"), 0, F.lit(1.0))), F.array().cast("array<string>"),
                     F.array().cast(f"array<{edge}>"), F.array().cast("array<int>"), F.lit(False)).cast(state)
    done = rows.withColumn("s", F.aggregate("first", start, step(1, F.col("m1")))).withColumn("s", F.aggregate("second", F.col("s"), step(2, F.col("m2"))))
    flat = lambda c: done.select(F.posexplode(f"s.{c}").alias("at", "x")).select("x.*", "at")
    return GraphView(root, flat("nodes"), flat("edges"), done.select("s.truncated"))


def blast_radius(g: RepoGraph, path: str, depth: int = 2, min_count: int = 2, limit: int = 12, max_files: int = 10) -> GraphView:
    """What changes together with a file, and with that; an unknown path is a lone root."""
    order = [F.desc("shared_commits"), "path"]
    first = [(blast_radius_direct(g, path, min_count, limit, max_files), "shared_commits", order)]
    second = [(blast_radius_transitive(g, path, min_count, limit * 2, max_files), "shared_commits", [order[0], "via", "path"])] if depth == 2 else None
    about = g.file.sparkSession.range(1).select(F.lit(path).alias("path"))
    return _radius(path, about, first, second, limit * 2 + 1, False, None)


def call_graph(g: RepoGraph, function_id: str, depth: int = 2, limit: int = 12) -> GraphView | None:
    """Callers and callees of a function, and theirs, with weights against the most calls in either direction; None for an
    unknown function."""
    about = g.function.where(F.col("id") == function_id).select(*BRIEF)
    if about.isEmpty():
        return None
    sides = ("callees", "callers")
    first = [(neighbours(g, function_id, d, limit), "call_count", [F.desc("call_count"), "id"]) for d in sides]
    second = [(second_neighbours(g, function_id, d, limit * 2), "call_count", [F.desc("call_count"), "via", "id"]) for d in sides] if depth == 2 else None
    return _radius(function_id, about, first, second, limit * 2 + 1, True, 1)


@dataclass
class _Lists:
    """A graph that is merged on the driver, for the command line."""

    root: str = ""
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    truncated: bool = False
    extra: dict = field(default_factory=dict)

    def dict(self) -> dict:
        found = asdict(self)
        return found | found.pop("extra")

    def node(self, id: str, kind: str, **more) -> None:
        self.nodes.append({"id": id, **NODE, "kind": kind, **more})

    def edge(self, source: str, target: str, weight: float, confidence: str = "high") -> None:
        self.edges.append({"source": source, "target": target, "weight": weight, "confidence": confidence})


def _function(row: dict) -> dict:
    return {"kind": "Function", "label": row["name"], "subtitle": f"{row['path']} - {row['qualname']}", "group": row["language"] or ""}


class _Merge:
    def __init__(self, root: dict, about, most: int, directed: bool):
        self.view, self.about, self.most, self.directed = _Lists(root["id"]), about, most, directed
        self.pairs: set = set()
        self.seen = {root["id"]}
        self.view.node(id=root["id"], **about(root))

    def edge(self, a: str, b: str, row: dict) -> None:
        pair = (a, b) if self.directed else frozenset((a, b))
        if pair not in self.pairs:
            self.pairs.add(pair)
            self.view.edge(a, b, row["n"], row.get("confidence") or "high")

    def node(self, row: dict, hop: int, most: int) -> bool:
        if row["id"] in self.seen:
            return True
        if hop == 2 and len(self.view.nodes) >= self.most:
            self.view.truncated = True
            return False
        self.seen.add(row["id"])
        self.view.node(row["id"], **self.about(row), hop=hop, weight=round(row["n"] / max(1, most), 3))
        return True

    def first(self, rows: list[dict], turn: bool = False, most: int | None = None) -> None:
        most = most or max((r["n"] for r in rows), default=1)
        for r in rows:
            self.node(r, 1, most)
            self.edge(*((r["id"], self.view.root) if turn else (self.view.root, r["id"])), r)

    def second(self, rows: list[dict], turn: bool = False, most: int | None = None) -> None:
        """Rows whose via is not shown are passed over; the first node beyond the limit ends it."""
        most = most or max((r["n"] for r in rows), default=1)
        for r in rows:
            if r["via"] in self.seen:
                if not self.node(r, 2, most):
                    return
                self.edge(*((r["id"], r["via"]) if turn else (r["via"], r["id"])), r)


def _rows(df: DataFrame, n: str, key: str) -> list[dict]:
    return [r.asDict() | {"n": r[n] or 1, "id": r[key]} for r in df.collect()]


def _function_root(g: RepoGraph, function_id: str) -> dict | None:
    row = g.function.where(F.col("id") == function_id).select(*BRIEF).first()
    return row and row.asDict()


def call_blast_radius(g: RepoGraph, function_id: str, depth: int = 1, fan_out: int = 30) -> _Lists | None:
    """The command line's version: the first fan_out in each direction, then of each of those; 2 * fan_out + 1 nodes.

    Calls between the function's direct neighbours are not shown. The neighbours of all first ones come from one join, at
    most fan_out of each.
    """
    root = _function_root(g, function_id)
    if root is None:
        return None
    merge = _Merge(root, _function, 2 * fan_out + 1, directed=True)
    near = {d: _rows(neighbours(g, function_id, d, fan_out), "call_count", "id") for d in ("callees", "callers")}
    for d, rows in near.items():
        merge.first(rows, d == "callers")
    direct = set(merge.seen)
    for d, rows in near.items():
        if depth < 2 or not rows:
            continue
        here, there = ("callee_id", "caller_id") if d == "callers" else ("caller_id", "callee_id")
        step = g.calls.where(F.col(here).isin([r["id"] for r in rows])).select(F.col(here).alias("via"), F.col(there).alias("id"), "confidence", "call_count")
        step = step.join(g.function.select(*BRIEF), "id")
        rank = F.row_number().over(Window.partitionBy("via").orderBy(F.desc("call_count"), "id"))
        far = _rows(step.withColumn("rank", rank).where(F.col("rank") <= fan_out).orderBy("rank"), "call_count", "id")
        order = {r["id"]: k for k, r in enumerate(rows)}
        others = sorted((x for x in far if x["id"] not in direct), key=lambda x: (order[x["via"]], x["rank"]))  # noqa: B023
        for x in others:
            if len(merge.view.nodes) >= merge.most:  # nothing more of this direction, not even a call to what is shown
                merge.view.truncated = True
                break
            merge.second([x], d == "callers", max(y["n"] for y in others))
    return merge.view


def file_call_view(g: RepoGraph, path: str) -> GraphView:
    """A file's functions and what they call elsewhere, which is shown once each at the border."""
    own = callgraph.file_functions(g, path)
    inside = node_rows(own, id=F.col("id"), kind="Function", label=F.col("name"), subtitle=F.col("qualname"), hop=1, group=F.coalesce("language", F.lit("")))
    calls = callgraph.file_call_graph(g, path)
    away = calls.where(F.col("target_path") != path).groupBy(F.col("target").alias("id")).agg(*[F.min(f"target_{c}").alias(c) for c in ("path", "name", "qualname", "language")])
    said = F.concat("path", F.lit(" - "), "qualname")
    border = node_rows(away, id=F.col("id"), kind="Function", label=F.col("name"), subtitle=said, hop=2, weight=0.6, group=F.coalesce("language", F.lit("")))
    return GraphView(path, inside.union(border), edge_rows(calls, "source", "target", "call_count", F.col("confidence")))


def function_map(g: RepoGraph, top_n: int = 60, edge_limit: int = 150) -> GraphView:
    """The most called functions and the calls among them."""
    few = callgraph.map_candidates(g, top_n)
    said = F.concat_ws(" - ", "path", "qualname", F.concat(F.col("caller_count").cast("string"), F.lit(" callers")))
    rows = placed(few, F.desc("caller_count"), "id")
    nodes = node_rows(rows, id=F.col("id"), kind="Function", label=F.col("name"), subtitle=said, hop=1, weight=F.col("weight"), group=F.coalesce("language", F.lit("")))
    edges = placed(callgraph.map_edges(g, few, edge_limit), F.desc("call_count"), "source", "target")
    return GraphView("", nodes, edge_rows(edges, "source", "target", "call_count", F.col("confidence")))


def author_network_view(g: RepoGraph, email: str, min_shared: int = 1, limit: int = 15) -> GraphView | None:
    """An author and those who share files with them; at_risk has the files only this author has touched. None if unknown."""
    about = ownership.author_detail(g, email)
    if about.isEmpty():
        return None
    near = ownership.author_network(g, email, min_shared, limit)
    most = near.agg(F.max("shared_files").alias("most"))
    rows = placed(near.crossJoin(F.broadcast(most)), F.desc("shared_files"), "email")  # one row
    said = F.concat(F.col("shared_files").cast("string"), F.lit(" shared file"), F.when(F.col("shared_files") != 1, "s").otherwise(""))
    weight = F.round(F.col("shared_files") / F.col("most"), 3)
    root = node_rows(about.withColumn("at", F.lit(0)), id=F.col("email"), kind="Author", label=F.col("name"), subtitle=F.col("email"))
    others = node_rows(rows, id=F.col("email"), kind="Author", label=F.col("name"), subtitle=said, hop=1, weight=weight)
    edges = edge_rows(rows.withColumn("root", F.lit(email)), "root", "email", "shared_files")
    return GraphView(email, root.union(others), edges, more={"at_risk": ownership.author_sole_owned_files(g, email)})


def topology_view(g: RepoGraph, top_n: int = 40, min_touches: int = 2, max_authors: int = 8, edge_limit: int = 120) -> GraphView:
    """The most active authors, grouped by the module that each works in most, and the files that pairs of them share."""
    rows = placed(ownership.topology_nodes(g, top_n), F.desc("commit_count"), "email")
    said = F.concat("name", F.lit(" - mostly works in "), F.coalesce("primary_module", F.lit("no single module")))
    nodes = node_rows(rows, id=F.col("email"), kind="Author", label=F.col("name"), subtitle=said, hop=1, weight=F.col("weight"), group=F.coalesce("primary_module", F.lit("")))
    pairs = ownership.shared_file_pairs(g, ownership.author_list(g, limit=top_n), min_touches, max_authors, edge_limit)
    return GraphView("", nodes, edge_rows(placed(pairs, F.desc("shared_files"), "email_a", "email_b"), "email_a", "email_b", "shared_files"))


def module_view(g: RepoGraph, min_count: int = 2, limit: int = 40, max_files: int = 10) -> GraphView:
    """Modules that change together."""
    edges = coupling.module_coupling_or_made(g, min_count, limit, max_files)
    rows = placed(coupling.module_graph_nodes(edges), F.desc("total"), "module")
    nodes = node_rows(rows, id=F.col("module"), kind="Module", label=F.col("module"), subtitle=F.col("module"), hop=1, weight=F.col("weight"))
    return GraphView("", nodes, edge_rows(placed(edges, F.desc("shared_commits"), "module_a", "module_b"), "module_a", "module_b", "shared_commits"))


def repo_map_view(g: RepoGraph, mode: str = "all-time", top_n: int = 40, max_files: int = 10, min_shared: int = 3, edge_limit: int = 120) -> GraphView:
    """The riskiest files and how densely they are coupled."""
    rows = placed(hotspots.repo_map_nodes(g, mode, top_n), F.desc("score"), "id")
    said = F.concat("id", F.lit(" - risk "), F.round("score", 2).cast("string"), F.when(F.col("sole_owned"), " - sole-owned").otherwise(""),
                    F.when(F.col("trending_worse"), " - trending up").otherwise(""))
    nodes = node_rows(rows, id=F.col("id"), kind="File", label=F.col("label"), subtitle=said, hop=1, weight=F.coalesce("weight", F.lit(0.0)),
                      sole_owned=F.col("sole_owned"), trending_worse=F.col("trending_worse"))
    return GraphView("", nodes, edge_rows(hotspots.repo_map_edges(g, mode, top_n, max_files, min_shared, edge_limit), "source", "target", "weight"))
