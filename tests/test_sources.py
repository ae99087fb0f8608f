import subprocess

import pytest
from pyspark.sql import functions as F

from lodestrata.functions.paths import extension_of, is_bug_fix, module_of
from lodestrata.operators import callgraph, resolve, risk
from lodestrata.sources import diffs, gitlog, pysource, tsjson

U = "\x1f"
LOG = (
    f"\x1eh3{U}Ann{U}ann@x{U}2024-03-03T10:00:00+02:00{U}third\n\n5\t1\tsrc/a.py\x002\t0\t\x00src/old.py\x00src/new.py\x00-\t-\timg.PNG\x00"
    f"\x1eh2{U}Bob{U}{U}2024-03-02T10:00:00+00:00{U}second\n1\t1\tsrc/a.py\x001\t1\tsrc/a.py\x00"
    f"\x1eh1{U}Ann Old{U}ann@x{U}2024-03-01T10:00:00+00:00{U}{'m' * 600}\n3\t0\tsrc/old.py\x004\t0\t\x00cut"
    f"\x1eh0{U}Ann{U}ann@x{U}2024-02-01T10:00:00+00:00{U}no files\n"
)


def test_log_tables(spark, tmp_path):
    got = gitlog.parse_log(gitlog.blocks(spark, LOG))
    files = {r.hash: [tuple(f) for f in r.files] for r in got.collect()}
    assert files == {
        "h3": [("src/a.py", 5, 1, "M", None), ("src/new.py", 2, 0, "R", "src/old.py"), ("img.PNG", 0, 0, "M", None)],
        "h2": [("src/a.py", 1, 1, "M", None)] * 2,
        "h1": [("src/old.py", 3, 0, "M", None)],
    }
    t = gitlog.tables(got)
    assert {r.email: r.name for r in t["author"].collect()} == {"ann@x": "Ann Old", "Bob@unknown.local": "Bob"}
    commits = {r.hash: r for r in t["commit"].collect()}
    assert (commits["h3"].additions, commits["h3"].files_changed, commits["h2"].files_changed, len(commits["h1"].message)) == (7, 3, 2, 500)
    rows = {r.path: (r.extension, r.module, r.has_rename_history) for r in t["file"].collect()}
    assert rows == {"src/a.py": ("py", "src", False), "src/new.py": ("py", "src", True), "src/old.py": ("py", "src", False), "img.PNG": ("png", "root", False)}
    assert t["modified"].count() == 5 and [tuple(r) for r in t["renamed_to"].collect()] == [("src/old.py", "src/new.py")]
    (tmp_path / "log").write_text(LOG)
    again = gitlog.parse_log(gitlog.read_blocks(spark, f"file://{tmp_path}/log"))
    assert [r.hash for r in again.orderBy("log_pos").collect()] == ["h3", "h2", "h1"]


def test_several_log_files_and_odd_paths(spark, tmp_path):
    block = lambda h, name, day, path: f"\x1e{h}{U}{name}{U}a@x{U}2024-03-{day}T10:00:00+00:00{U}s\n1\t1\t{path}\x00"
    (tmp_path / "log1").write_text(block("h3", "New", "03", "a\nb.py") + block("h2", "Mid", "02", "c.py"))
    (tmp_path / "log2").write_text(block("h1", "Old", "01", "d.py"))
    commits = gitlog.parse_log(gitlog.read_blocks(spark, f"file://{tmp_path}/log*"))
    assert [r.hash for r in commits.orderBy("log_pos").collect()] == ["h3", "h2", "h1"]
    t = gitlog.tables(commits)
    assert [r.name for r in t["author"].collect()] == ["Old"]
    assert {r.path for r in t["file"].collect()} == {"a\nb.py", "c.py", "d.py"}


def test_targets():
    from lodestrata.cli import is_url

    far = ["https://h/x", "HTTP://h/x", "ssh://git@h/x", "git@h:o/x", "Git@h:o/x", "/srv/x.git", "x.GIT"]
    assert all(map(is_url, far)) and not any(map(is_url, [".", "/srv/x", "C:/x", "httpx"]))


def test_real_repository(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-c", "user.name=T", "-c", "user.email=t@x", "-C", str(tmp_path), *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("def f():\n    return 1\n\n\ndef g():\n    return f()\n")
    run("add", ".")
    run("commit", "-qm", "start")
    (tmp_path / "a.py").write_text("def f():\n    return 2\n\n\ndef g():\n    return f()\n")
    run("commit", "-qam", "fix: f")
    run("mv", "a.py", "b é.py")
    run("commit", "-qm", "move")
    t = gitlog.tables(gitlog.parse_log(gitlog.blocks(spark, gitlog.log_text(str(tmp_path)))))
    assert sorted(tuple(r) for r in t["renamed_to"].collect()) == [("a.py", "b é.py")] and t["commit"].count() == 3
    assert [r.path for r in gitlog.head_paths(spark, str(tmp_path)).collect()] == ["b é.py"]
    hunks = diffs.file_hunks(diffs.patch_logs(spark, str(tmp_path), spark.createDataFrame([("a.py",), ("none",)], "path string"))).collect()
    assert ("fix: f", 2, 2) in {(r.message, r.lo, r.hi) for r in hunks}
    with pytest.raises(gitlog.GitError):
        gitlog.log_text(str(tmp_path / "none"))


def test_diff_hunks(spark):
    diff = (
        "diff --git a/x.py b/x.py\n--- a/x.py\n+++ b/x.py\n@@ -1,2 +3,4 @@ def\n+a\n@@ -9 +12 @@\n@@ -20,3 +15,0 @@\n"
        "diff --git a/y b/y\n--- a/y\n+++ /dev/null\n@@ -1,5 +0,0 @@\n--- /dev/null\n+++ b/z z.py\n@@ -0,0 +1,2 @@\n"
    )
    got = diffs.diff_hunks(spark.createDataFrame([(diff,), ("",), (None,)], "text string")).collect()
    assert sorted(tuple(r) for r in got) == [("x.py", 3, 6), ("x.py", 12, 12), ("x.py", 15, 15), ("z z.py", 1, 2)]
    # what is added or removed may look like a header
    odd = "--- a/c.c\n+++ b/c.c\n@@ -1,2 +1,3 @@\n--- i\n+++ counter\n+++ b/other.c\n \n@@ -9 +10 @@\n-x\n+y\n\\ No newline at end of file\n+++ nowhere\n@@ -1 +1 @@\n"
    got = diffs.diff_hunks(spark.createDataFrame([(odd,)], "text string")).collect()
    assert sorted(tuple(r) for r in got) == [("c.c", 1, 3), ("c.c", 10, 10)]


SOURCES = {
    "pkg/__init__.py": "",
    "pkg/a.py": "import pkg.b as bee\nfrom .b import helper as h, thing\nfrom . import c\n\nclass K:\n    x = make()\n    @property\n    def p(self):\n        return self.q()\n"
    "    @p.setter\n    def p(self, v):\n        pass\n    def q(self):\n        return bee.thing() + c.run() + h() + thing()\n\ndef make():\n    def inner(z):\n        return [i for i in z if i and z or 1]\n"
    "    return inner(make())\n",
    "pkg/b.py": "def thing():\n    while True:\n        try:\n            pass\n        except ValueError:\n            pass\n\ndef helper():\n    only_here()\n",
    "pkg/c.py": "def run():\n    match 1:\n        case 1: pass\n        case _: pass\n    return 1 if 2 else 3\n",
    "d.py": "from pkg import b\ndef only_here():\n    b.thing()\n    thing()\n",
    "bad.py": "def (",
}


def test_python_sources(spark):
    got = pysource.parse(spark.createDataFrame(list(SOURCES.items()), "path string, source string")).cache()
    functions = got.select(F.inline("functions"))
    rows = {r.id: r for r in functions.collect()}
    assert set(rows) == {"pkg/a.py::K.p", "pkg/a.py::K.p#2", "pkg/a.py::K.q", "pkg/a.py::make", "pkg/a.py::make.inner", "pkg/b.py::thing", "pkg/b.py::helper", "pkg/c.py::run", "d.py::only_here"}
    assert rows["pkg/a.py::K.p"].start_line == 7 and rows["pkg/a.py::K.p"].is_method and not rows["pkg/a.py::make.inner"].is_method
    assert {k: rows[k].complexity for k in ("pkg/a.py::make.inner", "pkg/b.py::thing", "pkg/c.py::run", "pkg/a.py::make")} == {
        "pkg/a.py::make.inner": 5, "pkg/b.py::thing": 3, "pkg/c.py::run": 4, "pkg/a.py::make": 1}
    files = spark.createDataFrame([(p,) for p in SOURCES], "path string")
    bound = resolve.resolve_imports(got.select(F.inline("bindings")), files)
    assert {(r.path, r.local): r.target for r in bound.collect()} == {
        ("pkg/a.py", "bee"): "pkg/b.py", ("pkg/a.py", "h"): "pkg/b.py", ("pkg/a.py", "thing"): "pkg/b.py", ("pkg/a.py", "c"): "pkg/c.py", ("d.py", "b"): "pkg/b.py"}
    edges = {(r.from_path, r.to_path): r.imported_names for r in resolve.import_edges(bound).collect()}
    assert edges["pkg/a.py", "pkg/b.py"] == ["helper", "pkg.b", "thing"]
    calls = {(r.caller_id, r.callee_id): r.resolution for r in resolve.resolve_calls(got.select(F.inline("sites")), functions, bound).collect()}
    q = "pkg/a.py::K.q"
    assert calls == {
        ("pkg/a.py::K", "pkg/a.py::make"): "same_file",  # a class body's caller is no function
        ("pkg/a.py::K.p", q): "same_file",
        (q, "pkg/b.py::thing"): "import_resolved",
        (q, "pkg/c.py::run"): "import_resolved",
        ("pkg/a.py::make", "pkg/a.py::make.inner"): "same_file",
        ("pkg/b.py::helper", "d.py::only_here"): "name_heuristic",
        ("d.py::only_here", "pkg/b.py::thing"): calls[("d.py::only_here", "pkg/b.py::thing")],  # one site by import, one by name
    }


def test_scan_reads_files(spark, tmp_path):
    tmp_path = tmp_path / "c++ (1).[x]"
    tmp_path.mkdir()
    for path, source in SOURCES.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(source)
    paths = spark.createDataFrame([(p,) for p in [*SOURCES, "x.md"]], "path string")
    rows = pysource.with_empty(pysource.scan(spark, str(tmp_path)), paths).collect()
    assert {r.path: r.source for r in rows} == SOURCES and len(rows) == len(SOURCES)


def test_analyzer_json(spark, tmp_path):
    (tmp_path / "ts.json").write_text(
        '{"functions": [{"id": "a.ts::f", "path": "a.ts", "name": "f", "source": "' + "x" * 20_001 + '"}, {"id": "a.ts::f", "path": "a.ts", "name": "g"}],'
        '"calls": [{"caller_id": "a.ts::f", "callee_id": "b.ts::h", "confidence": "low", "line": 3}], "imports": [{"from_path": "a.ts", "to_path": "b.ts", "imported_names": ["h"]}]}'
    )
    got = tsjson.read(spark, f"file://{tmp_path}/ts.json")
    assert [r.name for r in got["functions"].collect()] == ["g"] and got["calls"].first().pos == 0 and got["imports"].count() == 1


def test_dedupe(spark):
    sites = [("a", "b", "low", "name_heuristic", 9, 0)] + [("a", "b", "high", "same_file" if i else "import_resolved", i, i + 1) for i in range(24)] + [("c", "b", "low", "x", 1, 0)]
    got = {r.caller_id: r for r in callgraph.dedupe_calls(spark.createDataFrame(sites, "caller_id string, callee_id string, confidence string, resolution string, line int, pos long")).collect()}
    assert (got["a"].confidence, got["a"].resolution, got["a"].call_count) == ("high", "import_resolved", 25)
    assert got["a"].call_lines == [9, *range(19)] and (got["c"].confidence, got["c"].resolution) == ("low", "x")
    names = spark.createDataFrame([("a", "b", ["z", "x"]), ("a", "b", ["x"]), ("a", "c", [])], "from_path string, to_path string, imported_names array<string>")
    assert {r.to_path: r.imported_names for r in callgraph.dedupe_imports(names).collect()} == {"b": ["x", "z"], "c": []}


def test_path_and_message_functions(spark):
    paths = [("a/b/c.TAR.GZ", "gz", "a"), ("README", "", "root"), (".gitignore", "", "root"), ("x/.env.local", "local", "x"), ("x/y.", "", "x")]
    got = spark.createDataFrame([(p,) for p, _, _ in paths], "path string").select("path", extension_of(F.col("path")), module_of(F.col("path"))).collect()
    assert [tuple(r) for r in got] == paths
    says = {"fix: a": True, "fix(b): c": True, "prefix it": False, "fixture": False, "Fixed it": True, "debug": False, "a BUG": True, "closes #12": True, "fixes": True, "": False}
    got = spark.createDataFrame([(m,) for m in says], "m string").select("m", is_bug_fix(F.col("m")).alias("f")).collect()
    assert {r.m: r.f for r in got} == says


def test_flags(spark):
    functions = spark.createDataFrame([("p::a", "p", "a", 1, 9, 4.0, 1), ("p::b", "p", "b", 10, 20, 1.0, 9), ("p::c", "p", "c", 21, 30, 0.0, 0), ("q::d", "q", "d", 1, 5, 2.0, 0)],
                                      "id string, path string, qualname string, start_line int, end_line int, risk_score double, caller_count long")
    hunks = spark.createDataFrame([("p", 8, 22), ("q", 9, 9)], "path string, lo int, hi int")
    assert [r.id for r in risk.flagged(functions, hunks).collect()] == ["p::a", "p::b"]
    assert "| `a` | p | 4.0000 | 1 |" in risk.markdown(risk.flagged(functions, hunks))
    assert risk.markdown(risk.flagged(functions, hunks.where("false"))) is None
    assert risk.risk_percentile(functions.where("false")).first().threshold == 0.0
