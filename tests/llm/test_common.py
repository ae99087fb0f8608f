from pyspark.sql import functions as F

from lodestrata.llm import common


def test_salted_joins_are_joins(spark, monkeypatch):
    rows = spark.range(300).selectExpr("if(id < 200, 7L, id) as k", "id as v")
    keys = spark.createDataFrame([(7, 200, ["x"] * 50), (201, 1, ["y"]), (205, 1, []), (999, 5, ["z"])], "k long, n long, load array<string>")
    for hot in (1, 16, 10_000):
        monkeypatch.setattr(common, "HOT_ROWS", hot)
        for how in ("inner", "left"):
            got = common.salted(rows, keys, "k", how).select("k", "v", "n", "load")
            want = rows.join(keys, "k", how).select("k", "v", "n", "load")
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    monkeypatch.setattr(common, "HOT_ROWS", 16)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = common.salted(rows, keys, "k")
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        held = df.withColumn("part", F.spark_partition_id()).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert held == 202 and "strategy=broadcast" in plan
    inner = [line for line in plan.splitlines() if "strategy=broadcast" in line]
    assert len(inner) == 1 and "_salt" not in inner[0]  # what keys carry is not broadcast


def test_lists_are_broadcast_by_their_bytes(spark, monkeypatch):
    keys = spark.createDataFrame([(1, [1] * 100), (2, [])], "k long, x array<long>")
    hinted = lambda: "broadcast" in common.sized_lists(keys, "x", 8)._jdf.queryExecution().analyzed().toString()
    assert hinted()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 64 * 2 + 800 - 1)
    assert not hinted()
