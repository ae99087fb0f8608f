import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestrata.functions.quantiles import quantile
from lodestrata.operators import callgraph, ranges, risk

SPAN, HUNK = "id string, path string, start_line int, end_line int", "path string, hash string, lo int, hi int, k int"


def plain(spans, hunks):
    return sorted((s[0], h[4]) for s in spans for h in hunks if None not in (*s, *h) and s[1] == h[0] and s[2] <= s[3] and h[2] <= h[3] and h[2] <= s[3] and h[3] >= s[2])


@pytest.mark.parametrize("hot", [10_000, 5, 1])
def test_pairs_by_brute_force(spark, hot):
    rng = random.Random(hot)
    spans = [(f"f{i}", rng.choice("abc"), a, a + rng.randrange(-3, 300)) for i in range(60) for a in [rng.randrange(0, 500)]]
    hunks = [(rng.choice("aaab"), f"h{i % 40}", a, a + rng.choice([-1, 0, 0, 1, 5, 63, 64, 200]), i) for i in range(200) for a in [rng.randrange(0, 700)]]
    spans += [("n", None, 1, 2), ("m", "a", None, 3), ("all", "a", 0, 10_000)]
    hunks += [(None, "h", 1, 2, 900), ("a", "h", None, 2, 901), ("b", "h", 0, 5000, 902)]
    got = ranges.overlapping(spark.createDataFrame(spans, SPAN), spark.createDataFrame(hunks, HUNK), hot)
    assert sorted((r.id, r.k) for r in got.collect()) == plain(spans, hunks)


def test_a_path_with_many_hunks_is_split(spark):
    """A million hunks of one path, a third of them in one place: pairs are dealt to many keys, none with more than hot of them."""
    n, hot = 1_000_000, 20_000
    at = F.when(F.col("id") % 3 == 0, F.lit(100)).otherwise((F.col("id") * 7919 % 100_000)).cast("int")
    hunks = spark.range(n).select(F.lit("p").alias("path"), F.col("id").cast("string").alias("hash"), at.alias("lo"), at.alias("hi"))
    spans = spark.range(10_000).select(F.concat(F.lit("f"), "id").alias("id"), F.lit("p").alias("path"), (F.col("id") * 10).cast("int").alias("start_line"), (F.col("id") * 10 + 9).cast("int").alias("end_line"))
    found = ranges.overlapping(spans, hunks, hot)
    assert found.count() == n
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_part" in plan.split("Join")[1].splitlines()[0] and "NestedLoop" not in plan and "CartesianProduct" not in plan
    counts = risk.change_history(spans, hunks.withColumn("message", F.lit("fix it")))
    assert counts.agg(F.sum("change_count"), F.sum("bug_fix_count")).first() == (n, n)


@pytest.mark.parametrize("few", [50_000, 40, 1])
def test_quantiles_are_exact(spark, few):
    rng = random.Random(few)
    con = duckdb.connect()
    lists = [
        [rng.gauss(0, 1) for _ in range(997)],
        [float(rng.randrange(4)) for _ in range(500)],
        [10.0 ** rng.randrange(-300, 300) for _ in range(300)] + [-1.7e308, 1.7e308],
        [5.0] * 100, [1.0], [1.0, 2.0], [0.0, -0.0, 5e-324],
    ]
    for values in lists:
        df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "x double").repartition(3)
        for q in (0.0, 0.1, 0.5, 0.9, 1.0):
            want = con.execute("select quantile_cont(x, ?::DOUBLE) from (select unnest(?) as x)", [q, values]).fetchone()[0]
            got = quantile(df, "x", q, few)
            assert got == pytest.approx(want, rel=1e-12, abs=0), (q, values[:5])
    assert quantile(spark.createDataFrame([(None,)], "x double"), "x", 0.5) is None


def test_percentile_has_no_aggregate_of_all_scores(spark):
    scores = spark.range(200_000).select((F.col("id") % 65_537 + 1).cast("double").alias("risk_score"))
    assert risk.risk_percentile(scores).first().threshold == pytest.approx(scores.agg(F.percentile("risk_score", 0.9)).first()[0])
    none = risk.risk_percentile(scores.where("risk_score < 0"))
    assert none.first().threshold == 0.0


def test_a_pair_of_many_sites_keeps_its_first_lines(spark):
    sites = spark.range(50_000).select(
        F.lit("a").alias("caller_id"), F.lit("b").alias("callee_id"), F.when(F.col("id") == 30_000, "high").otherwise("low").alias("confidence"),
        F.concat(F.lit("r"), "id").alias("resolution"), (50_000 - F.col("id")).cast("int").alias("line"), F.col("id").alias("pos"),
    )
    found = callgraph.dedupe_calls(sites)
    assert [tuple(r) for r in found.collect()] == [("a", "b", "high", "r30000", 50_000, [50_000 - i for i in range(20)])]
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
