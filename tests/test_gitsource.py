import subprocess

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestrata.plans import ingest
from lodestrata.sources import gitlog, gitsource


@pytest.fixture()
def repo(tmp_path):
    where = tmp_path / "repo"
    where.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(where), "-c", "user.name=A", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    git("init", "-q")

    def commit(n, name="a.txt"):
        (where / name).parent.mkdir(parents=True, exist_ok=True)
        (where / name).write_text(f"{n}\n" * (n + 1))
        git("add", ".")
        git("commit", "-q", "-m", f"commit é {n}")

    for n in range(7):
        commit(n, ["a.txt", "b/c d.txt", "b/e/é.py"][n % 3])
    return str(where), commit


def commits(df):
    return sorted((r.hash, r.message, str(r.files)) for r in gitlog.parse_log(df).collect())


def test_ranges_are_the_log(spark, repo):
    gitsource.register(spark)
    path, _ = repo
    want = commits(gitlog.blocks(spark, gitlog.log_text(path)))
    for size in (1, 3, 100):
        df = spark.read.format("git_log").option("path", path).option("commitsPerPartition", size).load()
        assert df.rdd.getNumPartitions() == -(-7 // size) and commits(df) == want and len(want) == 7
        assert sorted(r.log_pos for r in df.collect()) == list(range(7))
    newest = [r.message for r in gitlog.parse_log(df).orderBy("log_pos").collect()]
    assert newest == [f"commit é {n}" for n in range(6, -1, -1)]
    assert spark.read.format("git_log").option("path", path).option("maxCommits", 2).load().count() == 2


def test_positions_are_pushed(spark, repo):
    gitsource.register(spark)
    df = spark.read.format("git_log").option("path", repo[0]).option("commitsPerPartition", 1).load()
    some = df.where((F.col("log_pos") >= 2) & (F.col("log_pos") < 4))
    assert some.rdd.getNumPartitions() == 2 and sorted(r.log_pos for r in some.collect()) == [2, 3]
    assert df.where(F.col("log_pos") == 5).count() == 1 and df.where(F.col("log_pos") > 90).count() == 0


def test_a_stream_adds_only_new_commits(spark, repo, tmp_path):
    gitsource.register(spark)
    path, commit = repo

    def run():
        stream = spark.readStream.format("git_log").option("path", path).option("commitsPerPartition", 2).load()
        query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        return [r.message for r in gitlog.parse_log(spark.read.parquet(f"{tmp_path}/out")).collect()]

    assert len(run()) == 7 and len(run()) == 7
    commit(7)
    commit(8, "new.py")
    assert sorted(run()) == [f"commit é {n}" for n in range(9)]


def test_the_tree_is_every_file(spark, repo):
    gitsource.register(spark)
    df = spark.read.format("git_tree").option("path", repo[0]).load()
    assert sorted(r.path for r in df.collect()) == ["a.txt", "b/c d.txt", "b/e/é.py"]


def test_failures_are_told(spark, repo, tmp_path):
    gitsource.register(spark)
    with pytest.raises(PySparkException, match="git rev-parse"):
        spark.read.format("git_log").option("path", str(tmp_path)).load().count()
    with pytest.raises(ValueError):
        ingest.validated("git@host:x", 10)
    assert ingest.validated("  https://host/x ", 9_000_000) == ("https://host/x", 5000) and ingest.validated("http://host/x", 0)[1] == 1
