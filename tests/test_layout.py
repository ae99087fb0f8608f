import pytest
from pyspark.sql import functions as F

from lodestrata.operators import ownership
from lodestrata.plans import layout, proxy


@pytest.fixture(scope="module")
def saved(spark, sf_small, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('graph')}/it's here"
    layout.save(proxy.graph(spark, sf_small), path, buckets=4)
    return path


def rows_of(df):
    return sorted(map(str, df.collect()))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_what_is_saved_is_loaded(spark, sf_small, saved):
    g, h = proxy.graph(spark, sf_small), layout.load(spark, saved)
    assert h.tables().keys() == g.tables().keys()
    for name, df in g.tables().items():
        assert rows_of(h.tables()[name].select(*df.columns)) == rows_of(df), name
    assert rows_of(ownership.author_stats(h)) == rows_of(ownership.author_stats(g))
    layout.save(h, saved.replace("it's", "again"), 2)  # from itself, elsewhere
    assert layout.load(spark, saved.replace("it's", "again")).commit.count() == g.commit.count()


def test_joins_by_the_key_have_no_exchange(spark, saved):
    h = layout.load(spark, saved)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "Exchange" not in plan(h.touches) and "SortMergeJoin" in plan(h.touches)
        per = h.touches.groupBy("hash").agg(F.count("*"))
        assert "Exchange" not in plan(per)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_lookup_reads_one_bucket(spark, saved):
    """Of a scan whose buckets nothing else needs, Spark shows them only if it is told to keep them; it reads one of them either way."""
    h = layout.load(spark, saved)
    path = h.file.first().path
    one = h.file.where(F.col("path") == path)
    assert one.count() == 1 and one.rdd.getNumPartitions() == 1
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    try:
        assert "SelectedBucketsCount: 1 out of 4" in plan(h.file.where(F.col("path") == path))
        assert "SelectedBucketsCount: 1 out of 4" in plan(h.commit.where("hash = '7'"))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
