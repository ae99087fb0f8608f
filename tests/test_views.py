import warnings

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestrata.operators import client, views
from lodestrata.plans import ingest
from lodestrata.plans.graph import RepoGraph
from lodestrata.sources import tssource


def graph(spark, calls, functions):
    rows = [(f"p::{n}", "p", n, f"K.{n}", "python", 1, 2, True, False, "", 1, 0, 0.0) for n in functions]
    function = spark.createDataFrame(rows, "id string, path string, name string, qualname string, language string, start_line int, end_line int, "
                                     "is_exported boolean, is_method boolean, source string, complexity int, change_count long, risk_score double")  # fmt: skip
    call = spark.createDataFrame([(f"p::{a}", f"p::{b}", c, "x", n) for a, b, c, n in calls], "caller_id string, callee_id string, confidence string, resolution string, call_count long")
    return RepoGraph(*[None] * 5, function=function, calls=call)


def test_call_graphs(spark):
    g = graph(spark, [("a", "b", "high", 4), ("c", "a", "low", 8), ("b", "d", None, 2), ("b", "a", "high", 1), ("d", "b", "high", 9), ("e", "c", "high", 3)], "abcde")
    view = views.call_graph(g, "p::a")
    nodes = {n["id"][-1]: n for n in view.nodes}
    assert (nodes["a"]["hop"], nodes["a"]["label"], nodes["a"]["subtitle"], nodes["a"]["group"]) == (0, "a", "p - K.a", "python")
    # weights are against the most calls in either direction
    assert (nodes["b"]["weight"], nodes["c"]["weight"], nodes["d"]["hop"], nodes["e"]["hop"]) == (0.5, 1.0, 2, 2)
    assert {(e["source"][-1] + e["target"][-1], e["confidence"]) for e in view.edges} == {("ab", "high"), ("ca", "low"), ("ba", "high"), ("bd", "high"), ("db", "high"), ("ec", "high")}
    assert views.call_graph(g, "no") is None and views.call_blast_radius(g, "no") is None
    radius = views.call_blast_radius(g, "p::a", depth=2)
    assert {n["id"][-1]: n["hop"] for n in radius.nodes} == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 2}
    few = views.call_blast_radius(g, "p::a", depth=2, fan_out=1)
    assert len(few.nodes) <= 3
    assert views.call_graph(g, "p::a").dict()["root"] == "p::a"


def test_client(spark):
    rows = spark.createDataFrame([("a", "x", 9.0), ("b", "y", 4.0), ("c", "y", 1.0), ("d", "y", None)], "path string, module string, risk_score double")
    tiers = lambda df: {r.path: r.tier for r in df.collect()}
    assert tiers(client.in_module(rows, "y")) == {"b": "critical", "c": "warning", "d": "good"}
    assert tiers(client.in_module(rows)) == {"a": "critical", "b": "warning", "c": "good", "d": "good"}
    assert tiers(client.severity(rows.select("path").union(rows.selectExpr("'z'")), rows)) == {"a": "critical", "b": "warning", "c": "good", "d": "good", "z": "good"}
    bars = spark.createDataFrame([(0.5,), (0.25,)], "v double")
    assert sorted(r.bar for r in client.bars(bars, "v").collect()) == [0.25, 0.5]
    names = spark.createDataFrame([("",), ("ab",), ("core/é",), ("a much longer name than 32 bits hold",)], "n string")
    for r in names.select("n", client.string_hash(F.col("n")).alias("h"), client.colour(F.col("n")).alias("c"), client.hash01(F.col("n")).alias("u")).collect():
        want = 0
        for c in r.n:
            want = (want * 31 + ord(c)) % 2**32
        assert (r.h, r.c, r.u) == (want, want % 8, want % 10_000 / 10_000)
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "z")], "source string, target string")
    known = client.known_edges(edges, spark.createDataFrame([("a",), ("b",), ("c",)], "id string"))
    assert known.count() == 3
    assert {r.id: r.neighbours for r in client.adjacency(known).collect()} == {"a": ["b"], "b": ["a", "c"], "c": ["b"]}
    places = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1.0, 0.0), ("c", 3.0, 0.0)], "id string, x double, y double")
    assert {(r.id, r.other) for r in client.nearest(places, 1).collect()} == {("a", "b"), ("b", "a"), ("c", "b")}


SCRIPT = """import def, { foo as f, bar, type Baz } from "./lib/util";
import * as ns from './ns.js';
import "./side";
export interface X { a(b: (c: number) => void): string; d: { e: () => void } }
type Fn = (a: string) => void;
// comment function no() {}
export async function outer<T>(a: T, cb: (x: number) => void = () => {}, o?: string): Promise<{ a: string }> {
  const re = /function\\/x() {/g, t = `hi ${a && inner(`n${b}`)} there`;
  function inner(x) { if (x || a) { return x ? 1 : 2; } return bar(); }
  for (const q of a ?? []) { switch (q) { case 1: { inner(q); break } default: f(); } }
  do { ns.go(); } while (a && b);
  return items.map((x) => x && y).filter(function (z) { return z || 1; });
}
export const arrow = async (p: string): Promise<void> => { try { await outer(p) } catch (e) { obj.method?.(e) } };
const single = x => x + 1, other = function named() { return single(2) }
let later;
later = () => 1;
export default class Klass<T> extends Base<T> implements I {
  private handler: (e: Event) => void = (e) => { this.run(e) };
  constructor(private a: string) { super(a); }
  get value() { return this.a }
  @Dec({ x: 1 })
  public async run(e?: Event): Promise<Map<string, { a: number }>> { while (e) { new Thing(); this.value.deep(); } return wait() }
  abstract nothing(): void;
}
const obj = { method(a) { return a }, key: (b) => outer(b), "quoted": function () { return 1 }, get x() { return 1 }, n: { m: () => f() } };
function App() { return <div onClick={() => arrow("x")}>it's {bar()} text</div> }
"""


def test_scripts(spark):
    files = {"src/a.tsx": SCRIPT, "src/lib/util.ts": "export function foo() {}\nexport const bar = () => foo();\n", "src/ns.ts": "export function go() { far(); }\n",
             "src/side/index.js": "function far() { go() }\nfunction twice() {}\n", "x.js": "function twice() { twice(); no() }\nfunction cut( {", "y.md": "function no() {}"}
    got = tssource.analyze(spark.createDataFrame(list(files.items()), "path string, source string"))
    rows = {r.id: r for r in got["functions"].collect()}
    a = {k.split("::")[1]: (r.start_line, r.end_line, r.is_exported, r.is_method, r.complexity) for k, r in rows.items() if r.path == "src/a.tsx"}
    assert a == {
        "outer": (7, 13, True, False, 6), "outer.inner": (9, 9, False, False, 4), "arrow": (14, 14, True, False, 2), "single": (15, 15, False, False, 1),
        "other": (15, 15, False, False, 1), "Klass.handler": (19, 19, False, False, 1), "Klass.run": (22, 23, False, True, 2), "method": (26, 26, False, True, 1),
        "key": (26, 26, False, False, 1), "quoted": (26, 26, False, False, 1), "m": (26, 26, False, False, 1), "App": (27, 27, False, False, 1),
    }
    assert rows["src/a.tsx::arrow"].source.startswith("export const arrow") and rows["src/a.tsx::Klass.run"].source.startswith("@Dec")
    assert rows["src/a.tsx::outer"].language == "typescript" and rows["x.js::twice"].language == "javascript"
    calls = {(r.caller_id.split("/")[-1], r.callee_id.split("/")[-1]): (r.confidence, r.resolution) for r in got["calls"].collect()}
    same, checked, low = ("high", "same_file"), ("high", "import_resolved"), ("low", "name_heuristic")
    assert calls == {
        ("a.tsx::outer", "a.tsx::outer.inner"): same, ("a.tsx::outer.inner", "util.ts::bar"): checked, ("a.tsx::outer", "util.ts::foo"): checked,
        ("a.tsx::outer", "ns.ts::go"): checked, ("a.tsx::arrow", "a.tsx::outer"): same, ("a.tsx::arrow", "a.tsx::method"): low, ("a.tsx::other", "a.tsx::single"): same,
        ("a.tsx::Klass.handler", "a.tsx::Klass.run"): same, ("a.tsx::key", "a.tsx::outer"): same, ("a.tsx::m", "util.ts::foo"): checked, ("a.tsx::App", "a.tsx::arrow"): same,
        ("a.tsx::App", "util.ts::bar"): checked, ("util.ts::bar", "util.ts::foo"): same, ("ns.ts::go", "index.js::far"): low, ("index.js::far", "ns.ts::go"): low,
    }
    edges = {(r.from_path, r.to_path): r.imported_names for r in got["imports"].collect()}
    assert edges == {("src/a.tsx", "src/lib/util.ts"): ["Baz", "bar", "def", "foo"], ("src/a.tsx", "src/ns.ts"): ["ns"], ("src/a.tsx", "src/side/index.js"): []}


def test_languages_by_extension(spark, monkeypatch):
    files = [("a.py", "def f():\n    g()\ndef g(): pass\n"), ("b.js", "function f() { g() }\nfunction g() {}\n"), ("c.rs", "fn f() {}")]
    sources = spark.createDataFrame(files, "path string, source string")
    found = ingest.analyze(sources)
    assert {r.id for r in found["functions"].collect()} == {"a.py::f", "a.py::g", "b.js::f", "b.js::g"} and found["calls"].count() == 2

    def broken(_):
        raise PySparkException("broken")

    monkeypatch.setattr(ingest, "LANGUAGES", ingest.LANGUAGES | {("py",): broken})
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        assert {r.language for r in ingest.analyze(sources)["functions"].collect()} == {"javascript"}
    assert any("py are left out" in str(w.message) for w in said)
    monkeypatch.setattr(ingest, "LANGUAGES", {("py",): broken})
    with pytest.warns(UserWarning), pytest.raises(RuntimeError):
        ingest.analyze(sources)


def test_name_hashes_are_of_utf16_units(spark):
    def plain(name):
        h, raw = 0, name.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = (h * 31 + int.from_bytes(raw[i : i + 2], "little")) % (1 << 32)
        return h

    names = ["", "a", "src/é", "x\U0001f600y", "\U0001f600" * 20, "\uffff\U00010000\U0010ffff"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r.h for r in rows.select(client.string_hash(F.col("name")).alias("h")).collect()] == [plain(n) for n in names]


def test_views_are_plans(spark, sf_small):
    """Nodes and edges of every view are tables that nothing was collected for but whether the root is there."""
    from lodestrata.plans import proxy

    g = proxy.graph(spark, sf_small)
    g.file_hotspot = spark.createDataFrame([], "path string, module string, commit_count long, risk_score double, risk_score_recent double")
    some = [views.topology_view(g), views.author_network_view(g, "n3"), views.module_view(g), views.function_map(g), views.file_call_view(g, "f7"),
            views.call_graph(g, "f7::fn27"), views.blast_radius(g, "none")]
    for view in some:
        for df, ddl in zip(view.frames(), (views.NODES, views.EDGES)):
            assert [c.split()[0] for c in ddl.split(", ")] == df.columns
            assert "LocalTableScan" not in df._jdf.queryExecution().optimizedPlan().toString()
        assert view.dict()["nodes"] == view.nodes
