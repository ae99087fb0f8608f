import json
import math
import subprocess
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lodestrata import cli
from lodestrata.functions import scores
from lodestrata.operators import callgraph, coupling, files, hotspots, lineage, ownership, views
from lodestrata.plans import graph, ingest
from lodestrata.plans.graph import RepoGraph, Settings
from lodestrata.plans.materialize import materialize
from lodestrata.streaming import history

AS_OF = "2024-01-11 00:00:00"


def repo(spark, touches, renames=(), deleted=(), **more):
    """touches: {hash: (author, day, [paths])}."""
    paths = {p for _, _, ps in touches.values() for p in ps} | {p for r in renames for p in r}
    targets = {n for _, n in renames}
    commit = [(h, a, f"fix {h}", f"2024-01-{d:02}T00:00:00+00:00", datetime(2024, 1, d), 1, 1, len(ps)) for h, (a, d, ps) in touches.items()]
    make = lambda rows, name: spark.createDataFrame(rows, graph.SCHEMAS[name])
    return RepoGraph(
        author=make([(a, a.upper()) for a in sorted({a for a, _, _ in touches.values()})], "author"),
        commit=make(commit, "commit"),
        file=make([(p, "py", p.split("/")[0], p in deleted, p in targets) for p in sorted(paths)], "file"),
        modified=make([(h, p, 1, 0, "M") for h, (_, _, ps) in touches.items() for p in dict.fromkeys(ps)], "modified"),
        renamed_to=make(list(renames), "renamed_to"),
        **more,
    )


CHAIN = [("a", "b"), ("b", "c"), ("b", "d"), ("x", "y"), ("y", "x")] + [(f"r{i}", f"r{i + 1}") for i in range(25)]


def test_lineage_of_chains_branches_and_cycles(spark):
    g = repo(spark, {"h": ("u", 1, ["a"])}, CHAIN)
    behind = {}
    for r in lineage.lineage(g).collect():
        behind.setdefault(r.root, set()).add(r.path)
    assert behind["c"] == {"a", "b", "c"} and behind["d"] == {"a", "b", "d"} and behind["x"] == {"x", "y"}
    assert behind["r25"] == {f"r{i}" for i in range(5, 26)}  # twenty steps back
    ahead = {}
    for r in lineage.canonical(g).collect():
        ahead.setdefault(r.path, set()).add(r.canonical)
    assert ahead["a"] == {"c", "d"} and "x" not in ahead and ahead["r5"] == {"r25"} and "r4" not in ahead


def test_hotspot_by_hand(spark):
    g = repo(spark, {"1": ("u", 1, ["m/a", "m/b"]), "2": ("v", 6, ["m/a", "m/b", "n/c"]), "3": ("u", 11, ["m/a"]), "4": ("u", 11, ["m/a"] + [f"z/{i}" for i in range(11)])}, deleted=["n/c"])
    row = {r.path: r for r in hotspots.hotspots(g, AS_OF, min_commits=3, half_life_days=10).collect()}["m/a"]
    w = math.exp(-1) + math.exp(-0.5) + 2
    cw = 2 * math.exp(-0.5)  # b and the deleted c, each at their latest small commit
    assert (row.commit_count, row.coupled_file_count, row.author_count) == (4, 2, 2)
    assert row.risk_score == pytest.approx(0.5 * 0.5 * math.log(5)) and row.risk_score_recent == pytest.approx(cw / w * 0.5 * math.log(w + 1))
    assert hotspots.hotspots(g, AS_OF, min_commits=5).count() == 0
    half = hotspots.hotspots(g, AS_OF, 3, half_life_days=10, kind="half_life").where("path = 'm/a'").first()
    assert half.risk_score_recent > row.risk_score_recent


def test_renamed_file_counts_its_past(spark):
    g = repo(spark, {"1": ("u", 1, ["old", "p"]), "2": ("v", 2, ["new", "q"]), "3": ("v", 3, ["old", "new"])}, [("old", "new"), ("q", "q2")], deleted=["old", "q"])
    row = {r.path: r for r in hotspots.hotspots(g, AS_OF, min_commits=1).collect()}["new"]
    assert (row.commit_count, row.coupled_file_count, row.author_count) == (3, 2, 2)
    assert files.file_detail(g, "new").first().commit_count == 4  # a commit counts for each path that it touched
    assert [(r.path, r.shared_commits) for r in coupling.co_changes(g, "new").collect()] == [("p", 1), ("q2", 1)]
    owners = {r.author_email: r.share for r in ownership.file_owners(g, "new").collect()}
    assert owners == {"v": pytest.approx(2 / 3), "u": pytest.approx(1 / 3)}
    assert len(files.file_recent_commits(g, "new").collect()) == 4


def test_shotgun_commits_leave_coupling_alone(spark):
    touches = {"1": ("u", 1, ["m/a", "n/b"]), "2": ("u", 2, ["m/a", "n/b"])}
    big = {"9": ("u", 3, ["m/a", "n/b"] + [f"o/{i}" for i in range(9)])}
    small, more = repo(spark, touches), repo(spark, touches | big)
    for f in (lambda g: coupling.co_changes(g, "m/a"), coupling.module_coupling):
        assert sorted(map(tuple, f(small).collect())) == sorted(map(tuple, f(more).collect()))
    assert [tuple(r) for r in coupling.module_coupling(more).collect()] == [("m", "n", 2)]


def test_criticality_by_hand(spark):
    g = repo(spark, {"1": ("u", 1, ["a", "b"]), "2": ("u", 2, ["a"]), "3": ("v", 3, ["b"]), "4": ("v", 4, ["c"])}, deleted=["c"])
    scored = spark.createDataFrame([("a", 2.0), ("b", 4.0)], "path string, risk_score double")
    g.file_hotspot = scored
    got = {r.email: (r.criticality_score, r.sole_owned_file_count) for r in ownership.criticality(g).collect()}
    assert got == {"u": (pytest.approx(2 * 1.5 + 0.1 + 4 * 0.5), 1), "v": (pytest.approx(4 * 0.5), 0)}
    assert {r.email for r in ownership.criticality(g, 0.6).collect()} == {"u"}


def test_connections(spark):
    g = repo(spark, {"1": ("a", 1, ["f1"]), "2": ("b", 1, ["f1", "f2"]), "3": ("c", 1, ["f2"]), "4": ("d", 1, ["f3"])})
    assert ownership.author_path(g, "a", "b")["hops"] == 2
    found = ownership.author_path(g, "a", "c")
    assert found["hops"] == 4 and [x for _, x in found["steps"]] == ["a", "f1", "b", "f2", "c"]
    assert not ownership.author_path(g, "a", "d")["found"]
    with pytest.raises(ValueError):
        ownership.author_path(g, "a", "a")


def test_blast_radius_view(spark):
    touches = {f"{i}{k}": ("u", 1, ["root", f"n{i}"]) for i in range(3) for k in range(2)} | {f"s{k}": ("u", 2, ["n0", "n1", "far"]) for k in range(2)}
    g = repo(spark, touches)
    view = views.blast_radius(g, "root")
    assert [n["id"] for n in view.nodes] == ["root", "n0", "n1", "n2", "far"] and not view.truncated
    assert {(e["source"], e["target"]) for e in view.edges} == {("root", "n0"), ("root", "n1"), ("root", "n2"), ("n0", "far"), ("n0", "n1"), ("n1", "far")}
    assert views.blast_radius(g, "root", limit=1).truncated
    assert views.blast_radius(g, "nowhere").nodes == [{"id": "nowhere", **views.NODE, "kind": "File", "label": "nowhere", "subtitle": "nowhere"}]


def test_call_views(spark):
    functions = [(x, "p", x, x, "python", 1, 2, True, False, "", 1, 0, 0.0) for x in "abcd"]
    calls = [("a", "b", "high", "same_file", 3, []), ("b", "c", "low", "name_heuristic", 1, []), ("d", "a", "high", "x", 2, []), ("Klass", "b", "high", "x", 1, [])]
    g = repo(spark, {"1": ("u", 1, ["p"])}, function=spark.createDataFrame(functions, graph.SCHEMAS["function"]), calls=spark.createDataFrame(calls, graph.SCHEMAS["calls"]))
    assert {r.id: r.caller_count for r in callgraph.functions_list(g).collect()} == {"a": 1, "b": 1, "c": 1, "d": 0}
    assert {r.callee_id: r.caller_count for r in callgraph.caller_counts(g.calls).collect()}["b"] == 2
    view = views.call_graph(g, "a")
    assert {(e["source"], e["target"]) for e in view.edges} == {("a", "b"), ("d", "a"), ("b", "c")}
    assert views.call_graph(g, "none") is None and len(views.call_blast_radius(g, "a", 2).nodes) == 4
    assert {r["problem"]: r["n"] for r in g.validate().collect()} == {"calls.caller_id without function": 1}


def test_materialize_save_load_and_update(spark, tmp_path):
    touches = {str(i): ("u" if i % 2 else "v", 1 + i % 9, ["m/a", "n/b"]) for i in range(10)}
    g = materialize(repo(spark, touches), AS_OF)
    assert hotspots.hotspots_or_scored(g, AS_OF).count() == 2 and g.author_stats.count() == 2 and g.coupled_with.count() == 1
    assert hotspots.repo_map_nodes(g).count() == 2 and hotspots.repo_map_edges(g).first().weight == 10.0
    graph.save(g, f"file://{tmp_path}/store")
    again = graph.load(spark, f"file://{tmp_path}/store")
    assert set(again.tables()) == set(g.tables()) and again.file_hotspot.count() == 2
    more = ingest.update(again, repo(spark, {"new": ("w", 9, ["m/a"]), "3": ("u", 2, ["m/a"])}), AS_OF)
    assert more.commit.count() == 11 and more.author_stats.count() == 3
    assert "commit" in again.register_views() and spark.sql("select count(*) n from commit").first().n == 10
    stats = files.repo_stats(repo(spark, {"x": ("u", 1, ["a"])}).__class__(**{k: v.where("false") for k, v in repo(spark, {"x": ("u", 1, ["a"])}).tables().items()})).first()
    assert (stats.file_count, stats.commit_count, stats.first_ts) == (0, 0, None)


def test_settings_pick_the_table(spark):
    g = materialize(repo(spark, {"1": ("u", 1, ["m/a", "n/b"])}), AS_OF)
    assert hotspots.hotspots_or_scored(g, AS_OF).count() == 0 and hotspots.hotspots_or_scored(g, AS_OF, min_commits=1).count() == 2
    assert coupling.module_coupling_or_made(g, 1).count() == 1 and g.settings == Settings()


def test_score_functions(spark):
    ages = {"2024-01-10 12:00:00": "today", "2024-01-01 00:00:00": "10d ago", "2023-11-12 00:00:00": "2mo ago", "2022-07-12 00:00:00": "1.5y ago"}
    rows = spark.createDataFrame([(t,) for t in ages], "t string").select("t", scores.relative_age(F.col("t").cast("timestamp"), AS_OF).alias("a"))
    assert {r.t: r.a for r in rows.collect()} == ages
    cases = [([(1.0, 2.0)], 0.0), ([], 0.0), ([(1.0, 5.0), (2.0, 5.0)], 0.0), ([(1.0, 3.0), (2.0, 2.0), (3.0, 1.0)], -1.0), ([(1.0, 1.0), (1.0, 2.0), (2.0, 3.0)], math.sqrt(3) / 2)]
    for data, rho in cases:
        row = scores.spearman(spark.createDataFrame(data, "x double, y double"), "x", "y").first()
        assert row.n == len(data) and row.rho == pytest.approx(rho)


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    record = {"hash": "h", "author_name": "A", "author_email": "a", "timestamp": "t", "message": "m", "log_pos": 0, "files": [{"path": "p", "additions": 1, "deletions": 0, "change_type": "M"}]}
    (source / "1.json").write_text(json.dumps(record) + "\n" + json.dumps(record) + "\n")
    for _ in range(2):
        history.append_history(history.read_commits(spark, f"file://{source}"), f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out/commit").count() == 1 and spark.read.parquet(f"file://{tmp_path}/out/modified").first().path == "p"
    at = [(datetime(2024, 1, 1, h, m), "k") for h, m in ((0, 0), (0, 10), (5, 0))]
    events = spark.createDataFrame(at, "ts timestamp, key string")
    assert sorted(r.n for r in history.sessions(events, "key").collect()) == [1, 2]
    assert sorted(r.n for r in history.churn(events, "key", "1 hour").collect()) == [1, 2]
    assert history.allowed([0, 1, 2, 10.5], [], 2, 10) == ([True, True, False, True], [1, 10.5])
    hits = tmp_path / "hits"
    hits.mkdir()
    (hits / "1.json").write_text("\n".join(json.dumps({"key": "k", "time": float(t)}) for t in (0, 1, 2)))
    stream = history.limited(spark.readStream.schema("key string, time double").json(f"file://{hits}"), 2, 10)
    stream.writeStream.format("memory").queryName("hits").option("checkpointLocation", f"file://{tmp_path}/hits-state").trigger(availableNow=True).start().awaitTermination()
    assert [r.allowed for r in spark.sql("select * from hits order by time").collect()] == [True, True, False]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=T", "-c", "user.email=t@x", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("def f():\n    return 1\n\n\ndef g():\n    return f()\n")
    run("add", ".")
    run("commit", "-qm", "start")
    (tmp_path / "a.py").write_text("def f():\n    return 2\n\n\ndef g():\n    return f()\n")
    run("commit", "-qam", "fix: f")
    monkeypatch.chdir(tmp_path)

    def call(*args):
        status = cli.main(list(args))
        return status, json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    assert call("search", "f")[0] == 1
    assert call("ingest", str(tmp_path), "--as-of", AS_OF)[1]["functions"] == 2
    assert [r["id"] for r in call("search", "A.PY")[1]] == ["a.py::f", "a.py::g"]
    assert call("function", "a.py::f")[1]["callers"][0]["id"] == "a.py::g" and call("function", "no")[0] == 1
    assert call("callees", "a.py::g")[1][0]["id"] == "a.py::f" and call("risk", "a.py")[1][0]["change_count"] == 2
    assert len(call("blast-radius", "a.py::f")[1]["nodes"]) == 2
    (tmp_path / "d").write_text("+++ b/a.py\n@@ -1 +2 @@\n")
    assert [r["id"] for r in call("check-diff", "d", "--markdown", "m.md")[1]] == ["a.py::f"] and "| `f` |" in (tmp_path / "m.md").read_text()


def test_registered_queries_match_their_sql(spark, sf_small):
    """All of them, as the driver compares them."""
    import duckdb

    from lodestrata import catalog

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in ("nation", "customer", "part", "orders", "lineitem", "events"):
        con.sql(f"create view {t} as select * from '{sf_small}/{t}.parquet'")
    shown = lambda v: round(v, 6) if isinstance(v, float) else v
    assert catalog.queries().keys() == catalog.oracle_sql().keys()
    for name, query in catalog.queries().items():
        df = query(spark, sf_small)
        columns = sorted(df.columns)
        got = sorted(str([shown(r[c]) for c in columns]) for r in df.collect())
        table = con.sql(catalog.oracle_sql()[name])
        assert sorted(table.columns) == columns, name
        at = [table.columns.index(c) for c in columns]
        assert got == sorted(str([shown(r[i]) for i in at]) for r in table.fetchall()), name
        assert got, name


def test_filters_reach_the_scan(spark, sf_small):
    from lodestrata.plans import proxy

    g = proxy.graph(spark, sf_small)
    plan = coupling.module_coupling(g, limit=None)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "l_extendedprice" not in plan and "p_retailprice" not in plan
