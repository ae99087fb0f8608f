import subprocess

import pytest
from pyspark.sql import functions as F

from lodestrata.plans import ingest
from lodestrata.sources import diffs, pysource, tssource


def test_files_that_are_not_read_are_listed(spark):
    files = {
        "good.py": "def f():\n    return 1\n", "bad.py": "x = 1\ndef f(:\n", "null.py": "a\0b", "deep.py": "(" * 5000 + ")" * 5000,
        "good.ts": "export function g() { return 1 }", "text.jsx": "const A = () => <p>don't {f(1)} can't</p>\nfunction f() {}",
        "two.tsx": "const B = () => (<p>a</p> && <b>{f(2)}</b>)", "plain.tsx": "const C = () => <p>it's {f(1)} fine</p>;\nfunction f() {}", "end.jsx": "const D = () => <p>a</p>\nfunction f() {}",
        "less.ts": "if (a </b/.exec(c)) { d('x'); e('y') }", "notes.md": "don't",
    }
    found = ingest.analyze(spark.createDataFrame(list(files.items()), "path string, source string"))
    unread = {r.path: r.reason for r in found["unread"].collect()}
    assert unread.keys() == {"bad.py", "null.py", "deep.py", "text.jsx", "two.tsx", "end.jsx"}
    assert unread["bad.py"].startswith("syntax error in line 2") and unread["text.jsx"] == unread["two.tsx"] == "text inside of markup is not read"
    assert {r.path for r in found["functions"].collect()} == {"good.py", "good.ts", "plain.tsx"}
    assert ("plain.tsx::C", "plain.tsx::f") in {(r.caller_id, r.callee_id) for r in found["calls"].collect()}
    assert not found["calls"].where("resolution = 'type_checked'").count()


def test_replaced_bytes_are_listed_and_read(spark, tmp_path):
    (tmp_path / "a.py").write_bytes(b"def f():\n    return '\xff'\n")
    (tmp_path / "b.py").write_bytes("def g():\n    return 'é'\n".encode())
    found = ingest.analyze(pysource.scan(spark, str(tmp_path)))
    assert [tuple(r) for r in found["unread"].collect()] == [("a.py", pysource.REPLACED)]
    assert {r.name for r in found["functions"].collect()} == {"f", "g"}


def test_paths_without_a_history_are_listed(spark, tmp_path):
    paths = spark.createDataFrame([("a.py",)], "path string")
    row = diffs.patch_logs(spark, str(tmp_path / "nowhere"), paths).first()
    assert (row.log, row.reason) == ("", "no history: CalledProcessError")


def test_a_language_that_fails_lists_its_files(spark, monkeypatch):
    def fails(sources):
        return {"functions": sources.select(F.raise_error(F.lit("no")).cast("string").alias("id"))}

    monkeypatch.setattr(ingest, "LANGUAGES", {("py",): ingest._python, tuple(tssource.EXTENSIONS): fails})
    with pytest.warns(UserWarning):
        found = ingest.analyze(spark.createDataFrame([("a.py", "def f(): pass"), ("b.ts", "")], "path string, source string"))
    assert [(r.path, r.reason[:19]) for r in found["unread"].collect()] == [("b.ts", "its language failed")]


def test_ingest_keeps_the_list(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=A", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("def f():\n    return 1\n")
    (tmp_path / "b.py").write_text("def f(:\n")
    git("add", ".")
    git("commit", "-q", "-m", "one")
    g = ingest.ingest(spark, str(tmp_path), "2030-01-01 00:00:00")
    assert [r.path for r in g.unread.collect()] == ["b.py"] and "unread" in g.tables()
