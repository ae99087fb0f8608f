"""What a client does with lists it was given: filters, bars, severities, colours, and the edges of what it shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import tier

#: Fixed values of the colour hash: its factor and the number of colours.
HASH_FACTOR, COLOURS = 31, 8


def in_module(files: DataFrame, module: str | None = None, score: str = "risk_score") -> DataFrame:
    """files of a module (all without one), with tier: each score against the largest of what is left."""
    rows = files if module is None else files.where(F.col("module") == module)
    most = rows.agg(F.max(score).alias("_most"))
    return rows.crossJoin(F.broadcast(most)).withColumn("tier", tier(F.col(score), F.col("_most"))).drop("_most")  # one row


def bars(rows: DataFrame, value: str) -> DataFrame:
    """rows with bar: value against the largest, or against 1 if that is more."""
    most = rows.agg(F.greatest(F.lit(1), F.max(value)).alias("_most"))
    return rows.crossJoin(F.broadcast(most)).withColumn("bar", F.col(value) / F.col("_most")).drop("_most")  # one row


def severity(files: DataFrame, scored: DataFrame, score: str = "risk_score") -> DataFrame:
    """files (path) with their score and tier against the riskiest of scored (path, score); null scores are good."""
    most = scored.agg(F.max(score).alias("_most"))
    own = scored.select("path", F.col(score).alias("_score"))
    rows = files.join(own, "path", "left").crossJoin(F.broadcast(most))  # one row
    return rows.withColumn("tier", tier(F.col("_score"), F.col("_most"))).drop("_score", "_most")


def string_hash(text: Column) -> Column:
    """An unsigned 32-bit hash: each UTF-16 unit is added to HASH_FACTOR times what was before. A character above U+FFFF is two units."""
    high = lambda c: F.lit(0xD800) + F.shiftright(c - 0x10000, 10)
    low = lambda c: F.lit(0xDC00) + (c - 0x10000).bitwiseAND(F.lit(0x3FF))
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))
    units = F.flatten(F.transform(points, lambda c: F.when(c > 0xFFFF, F.array(high(c), low(c))).otherwise(F.array(c))))
    return F.aggregate(units, F.lit(0).cast("long"), lambda h, c: F.pmod(h * HASH_FACTOR + c, F.lit(1 << 32)))


def colour(text: Column) -> Column:
    return F.pmod(string_hash(text), F.lit(COLOURS)).cast("int")


def hash01(text: Column) -> Column:
    """The hash as a number from 0 to 1."""
    return F.pmod(string_hash(text), F.lit(10_000)) / 10_000.0


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (source, target) whose ends are both among nodes (id)."""
    ids = nodes.select("id").distinct()
    found = edges.join(ids.withColumnRenamed("id", "source"), "source", "left_semi")
    return found.join(ids.withColumnRenamed("id", "target"), "target", "left_semi").select(*edges.columns)


def adjacency(edges: DataFrame) -> DataFrame:
    """id, neighbours (sorted) of each end of edges, whatever their direction."""
    both = edges.select(F.col("source").alias("id"), F.col("target").alias("other")).union(edges.select("target", "source"))
    return both.groupBy("id").agg(F.array_sort(F.collect_set("other")).alias("neighbours"))


def nearest(places: DataFrame, k: int = 4) -> DataFrame:
    """id, other, rank of each node's k nearest by distance of places (id, x, y) of a view's few hundred nodes."""
    a, b = places.alias("a"), places.alias("b")
    pairs = a.join(b, F.col("a.id") != F.col("b.id"))  # of nodes of one view
    far = F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")).alias("far")
    rows = pairs.select(F.col("a.id").alias("id"), F.col("b.id").alias("other"), far)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("far", "other"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "other", "rank")
