import glob
import json
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import job1_history_update as job1
from jobs import job2_search_index as job2
from jobs import runner
from lodestrata.operators import coupling, files, ownership, trigrams
from lodestrata.plans import increment, proxy

AS_OF = proxy.AS_OF


def rows_of(df):
    return sorted(str({k: round(v, 6) if isinstance(v, float) else v for k, v in r.asDict().items()}) for r in df.collect())


def copied(spark, sf_dir, to, upto=None, name_of=lambda n: f"{n}.parquet"):
    """The proxy's tables under to, of the orders up to a number."""
    for name in proxy.BASE:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        key = {"orders": "o_orderkey", "lineitem": "l_orderkey"}.get(name)
        if key and upto is not None:
            df = df.where(F.col(key) <= upto)
        df.write.mode("overwrite").parquet(f"{to}/{name_of(name)}")


def test_increments_equal_a_rebuild(spark, sf_small, tmp_path):
    out, tables = str(tmp_path / "out"), str(tmp_path / "in")
    taken = []
    for upto, as_of in ((500, "2000-01-01 00:00:00"), (501, "2000-06-01 00:00:00"), (None, AS_OF)):
        copied(spark, sf_small, tables, upto)
        taken.append(job1.run(spark, tables, out, {"as_of": as_of}))
    assert [t["batch"] for t in taken] == [1, 2, 3] and taken[1]["commits"] == 1 and taken[1]["modules"] < taken[0]["modules"]
    again = job1.run(spark, tables, out)
    assert again == {"batch": 3, "commits": 0, "modules": 0}
    whole = str(tmp_path / "whole")
    assert job1.run(spark, tables, whole)["commits"] == sum(t["commits"] for t in taken)
    for name in ("authors", "coupled", "author_modules"):
        assert rows_of(spark.read.parquet(f"{out}/{name}")) == rows_of(spark.read.parquet(f"{whole}/{name}")), name
    assert rows_of(increment.churn_at(spark, out, AS_OF, 180.0)) == rows_of(increment.churn_at(spark, whole, AS_OF, 180.0))
    g = proxy.graph(spark, sf_small)
    want = rows_of(ownership.author_stats(g).select("email", "commit_count", "file_count", "first_ts", "last_ts"))
    assert rows_of(spark.read.parquet(f"{out}/authors")) == want
    assert rows_of(spark.read.parquet(f"{out}/coupled")) == rows_of(coupling.module_coupling(g, 1, None))


def test_an_update_touches_only_its_modules(spark, sf_small, tmp_path):
    out, tables = str(tmp_path / "out"), str(tmp_path / "in")
    copied(spark, sf_small, tables, 500)
    job1.run(spark, tables, out)
    files_of = lambda: {p: os.stat(p).st_mtime_ns for p in glob.glob(f"{out}/churn/module=*/*.parquet")}
    before = files_of()
    copied(spark, sf_small, tables, 501)
    touched = {r.module for r in proxy.graph(spark, tables, after=500).modified.join(proxy.graph(spark, tables).file, "path").select("module").distinct().collect()}
    job1.run(spark, tables, out)
    changed = {p.split("module=")[1].split("/")[0] for p in before.items() ^ files_of().items() for p in [p[0]]}
    assert {m.replace("%23", "#") for m in changed} == touched


def test_an_interrupted_update_is_done_again(spark, sf_small, tmp_path, monkeypatch):
    out, tables = str(tmp_path / "out"), str(tmp_path / "in")
    copied(spark, sf_small, tables, 500)
    job1.run(spark, tables, out)
    copied(spark, sf_small, tables, 900)
    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(increment, "_replace", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        job1.run(spark, tables, out)
    assert increment.last_mark(spark, out) == (1, spark.read.parquet(f"{out}/marks").first().high)
    copied(spark, sf_small, tables)  # more has come since
    job1.run(spark, tables, out)
    whole = str(tmp_path / "whole")
    job1.run(spark, tables, whole)
    assert rows_of(increment.churn_at(spark, out, AS_OF, 180.0)) == rows_of(increment.churn_at(spark, whole, AS_OF, 180.0))
    assert rows_of(spark.read.parquet(f"{out}/authors")) == rows_of(spark.read.parquet(f"{whole}/authors"))


def test_the_mark_reaches_the_scans(spark, sf_small):
    g = proxy.graph(spark, sf_small, after=700)
    for df, filter_ in ((g.commit, "GreaterThan(o_orderkey,700)"), (g.modified, "GreaterThan(l_orderkey,700)")):
        assert filter_ in df._jdf.queryExecution().executedPlan().toString()


TEXTS = [(1, "Fix the PARSER"), (2, "parse"), (3, None), (4, ""), (5, "pa"), (None, "parser"), (4100, "a Parser, ÄÖÜ é"), (1, "Fix the PARSER"), (7, "xxxx 100%_")]


def test_search_equals_a_scan(spark, tmp_path):
    rows = spark.createDataFrame(TEXTS, "id long, text string").withColumn("name", F.concat(F.lit("n"), F.col("id").cast("string")))
    for key, bits in (("id", trigrams.BITS), ("name", trigrams.hashed_bits(8))):
        trigrams.write(trigrams.postings(rows, key, "text", bits), f"{tmp_path}/{key}")
        lists = spark.read.schema(trigrams.SCHEMA).parquet(f"{tmp_path}/{key}")
        for term in ("pars", "PARSER", "äöü", "fix the p", "xxx", "0%_", "nothing", "é", "pa", "", "parser, "):
            want = [r for r in TEXTS if r[1] is not None and term.lower() in r[1].lower() and (r[0] is not None or len(term) < 3)]
            got = trigrams.find(rows, lists, key, "text", term).select("id", "text")
            assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want)), (key, term)


def test_lists_by_definition(spark):
    rows = spark.createDataFrame(TEXTS, "id long, text string")
    got = {(r.gram, r.block): (r.n, r.ids) for r in trigrams.postings(rows, "id", "text").collect()}
    want = {}
    for i, t in TEXTS:
        low = (t or "").lower()
        for g in {low[k : k + 3] for k in range(len(low) - 2)} if i is not None else ():
            want.setdefault((g, i >> trigrams.BITS), set()).add(i)
    assert got == {k: (len(v), sorted(v)) for k, v in want.items()}


def test_search_reads_its_lists_only(spark, tmp_path):
    rows = spark.createDataFrame(TEXTS, "id long, text string")
    trigrams.write(trigrams.postings(rows, "id", "text"), str(tmp_path / "i"))
    lists = spark.read.schema(trigrams.SCHEMA).parquet(str(tmp_path / "i"))
    plan = trigrams.candidates(lists, "pars")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram, [ars,par])" in plan and "PartitionFilters: [shard" in plan


def test_index_by_growing_files(spark, sf_small, tmp_path):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    docs.where("doc_id % 3 = 0").coalesce(1).write.parquet(f"{source}/documents.parquet")
    assert job2.run(spark, source, out)["batches"] == 1
    first = glob.glob(f"{out}/postings/batch=0/*/*.parquet")
    docs.where("doc_id % 3 > 0").coalesce(1).write.mode("append").parquet(f"{source}/documents.parquet")
    assert job2.run(spark, source, out) == {"batches": 1, "rows": docs.where("doc_id % 3 > 0").count()}
    assert job2.run(spark, source, out) == {"batches": 0, "rows": 0}
    assert set(first) <= set(glob.glob(f"{out}/postings/*/*/*.parquet"))
    whole = trigrams.postings(docs, "doc_id", "text").select("gram", F.explode("ids").alias("id"))
    pairs = job2.lists(spark, out).select("gram", F.explode("ids").alias("id"))
    assert pairs.count() == whole.count() and pairs.exceptAll(whole).isEmpty()
    term = docs.orderBy("doc_id").first().text[5:25]
    got = trigrams.find(docs, job2.lists(spark, out), "doc_id", "text", term)
    assert rows_of(got) == rows_of(docs.where(F.lower("text").contains(term.lower()))) and got.count() > 0


def test_queries_match_their_sql(spark, sf_small):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in (*proxy.BASE, "documents"):
        con.sql(f"create view {t} as from '{sf_small}/{t}.parquet'")
    for job in (job1, job2):
        df = job.query(spark, sf_small)
        columns = sorted(df.columns)
        want = con.sql(f"select {', '.join(columns)} from ({job.SQL})").fetchall()
        assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want) and want
    g = proxy.graph(spark, sf_small)
    index = files.text_index(g.commit, "hash", "message")
    assert rows_of(files.search_commits_indexed(g, index, "bug #1")) == rows_of(files.search_commits(g, "bug #1"))


def test_command_lines(sf_small, tmp_path):
    """Each in a session of its own, twice, with a config file."""
    for job, settings in (("job1_history_update", {"half_life_days": 90.0}), ("job2_search_index", {"bits": 4})):
        config = tmp_path / "config.json"
        config.write_text(json.dumps(settings))
        args = [sys.executable, "-m", f"jobs.{job}", sf_small, str(tmp_path / job), "--config", str(config)]
        for _ in range(2):
            done = subprocess.run(args, cwd=os.path.dirname(os.path.dirname(__file__)), capture_output=True, text=True, timeout=300)
            assert done.returncode == 0, done.stderr[-2000:]
            assert "read" in done.stderr
        assert glob.glob(f"{tmp_path}/{job}/**/*.parquet", recursive=True)
    with pytest.raises(ValueError):
        config.write_text('{"other": 1}')
        runner.configured(str(config), job1.DEFAULTS)


def test_shipped_configs_are_the_defaults():
    for job in (job1, job2):
        name = job.__name__.split(".")[1]
        assert runner.configured(f"{os.path.dirname(job.__file__)}/config/{name}.json", job.DEFAULTS) == job.DEFAULTS
