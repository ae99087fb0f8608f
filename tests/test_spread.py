"""Work that grows with rows is dealt to tasks, and nothing that grows is broadcast, however small the files look."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata import runtime
from lodestrata.operators import resolve
from lodestrata.sources import pysource, tssource

SOURCES = {"py": (pysource, "def f(x):\n    return g(x)\n"), "ts": (tssource, "function f(x) { return g(x); }\n")}


@pytest.mark.parametrize("language", SOURCES)
def test_sources_of_one_partition_are_parsed_by_many_tasks(spark, language):
    module, text = SOURCES[language]
    sources = spark.range(400).coalesce(1).select(F.concat(F.lit("m"), "id", F.lit(f".{language}")).alias("path"), F.lit(text).alias("source"))
    tasks = module.parse(sources).select("path", F.size("functions").alias("n"), F.spark_partition_id().alias("task")).collect()
    assert len({r.task for r in tasks}) > 4
    assert sorted(r.path for r in tasks) == sorted(f"m{i}.{language}" for i in range(400)) and all(r.n == 1 for r in tasks)


def test_rows_share_batches_of_bounded_size():
    schema = pa.schema([("text", pa.string()), ("n", pa.int32())])
    rows = [("x" * 10, i) for i in range(25_000)]
    few = list(runtime.batched(rows, schema))
    assert [b.num_rows for b in few] == [10_000, 10_000, 5_000] and [r for b in few for r in b["n"].to_pylist()] == list(range(25_000))
    long = list(runtime.batched([("x" * runtime.BATCH_CHARS, 1)] * 3, schema))
    assert [b.num_rows for b in long] == [1, 1, 1] and list(runtime.batched([], schema)) == []


def test_names_are_not_broadcast(spark):
    parsed = runtime.written(pysource.parse(spark.createDataFrame([("a.py", "from b import g\ndef f(x):\n    return g(x) + h()\n"), ("b.py", "def g(x):\n    return f(x)\n")], "path string, source string")), "parsed")
    bound = resolve.resolve_imports(parsed.select(F.inline("bindings")), parsed.select("path"))
    calls = resolve.resolve_calls(parsed.select(F.inline("sites")), parsed.select(F.inline("functions")), bound)
    assert "BroadcastHashJoin" not in calls._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r)[:4] for r in calls.collect()) == [
        ("a.py::f", "b.py::g", "high", "import_resolved"), ("b.py::g", "a.py::f", "low", "name_heuristic"),
    ]


def test_modules_are_not_broadcast(spark):
    bindings = spark.createDataFrame([("src/a.ts", "h", "./b.js", "g", 0, 0)], pysource.BINDING)
    found = tssource.resolve_modules(bindings, spark.createDataFrame([("src/a.ts",), ("src/b.ts",)], "path string"))
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.target for r in found.collect()] == ["src/b.ts"]


def test_files_of_a_log_need_no_join(spark):
    from lodestrata.sources import gitlog

    U = gitlog.UNIT
    blocks = [(0, f"h1{U}a{U}a@x{U}2020-01-01{U}m\n1\t1\tq.py\0" "2\t2\t\0p.py\0q.py\0"), (1, f"h2{U}a{U}a@x{U}2020-01-02{U}m\n1\t1\tp.py\0" "1\t0\tr/s.py\0")]
    file = gitlog.tables(gitlog.parse_log(spark.createDataFrame(blocks, "log_pos long, block string")))["file"]
    assert "Join" not in file._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.path, r.has_rename_history) for r in file.collect()) == [("p.py", False), ("q.py", True), ("r/s.py", False)]


def test_partners_are_sent_as_lists(spark):
    from lodestrata.operators import hotspots

    named = spark.createDataFrame([(n, [n], [n]) for n in range(3)], "number long, roots array<long>, today array<long>")
    small = spark.createDataFrame([(0, "h", 1.0), (1, "h", 1.0), (2, "h", 1.0), (0, "i", 0.5), (1, "i", 0.5)], "number long, hash string, w double")
    found = hotspots._partners(named, small)
    sent = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "hashpartitioning(" in line]
    assert sent and not any("other" in line for line in sent)
    assert sorted(tuple(r) for r in found.collect()) == [(0, 2, 2.0), (1, 2, 2.0), (2, 2, 2.0)]


def test_touches_are_dealt_by_path(spark, sf_small):
    from lodestrata.operators import files, ownership
    from lodestrata.plans import proxy

    g = proxy.graph(spark, sf_small)
    for df in (ownership.author_files(g), ownership.sole_owned(g, g.file), ownership.author_sole_owned_files(g, "n3"), ownership.primary_modules(g, g.author), files.module_list(g)):
        assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
