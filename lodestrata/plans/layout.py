"""A saved graph in buckets: joins on a bucket key need no shuffle, and a lookup by it reads one bucket.

Tables are Parquet under explicit paths, bucketed and sorted by Spark's writer; the number of buckets and the keys are written beside
them. A session that loads them names them in its own catalog, under names that no other call has, and forgets them when it
ends; the files are what stays.
"""

from __future__ import annotations

import uuid
from dataclasses import fields

from pyspark.sql import DataFrame, SparkSession

from .graph import RepoGraph, Settings

#: The bucket key of each table: what it is joined on and looked up by.
KEYS = {"commit": "hash", "modified": "hash", "file": "path", "author": "email", "function": "id", "calls": "caller_id", "file_hotspot": "path"}
#: Buckets, unless the caller knows better: about as many as tasks of 128 MB that the largest table has.
BUCKETS = 32


def _name(of: str) -> str:
    return f"lodestrata_{of}_{uuid.uuid4().hex}"


def save(g: RepoGraph, path: str, buckets: int = BUCKETS) -> None:
    """Each table under path; those with a key in buckets of it, each bucket in one sorted file."""
    spark, layout = g.file.sparkSession, []
    for name, df in g.tables().items():
        key, at = KEYS.get(name), f"{path}/{name}"
        if key is None:
            df.write.mode("overwrite").parquet(at)
            continue
        table = _name(name)
        rows = df.repartition(buckets, key)  # else each task would write a file for each bucket
        rows.write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).option("path", at).saveAsTable(table)
        spark.sql(f"DROP TABLE {table}")  # of an explicit path: the files stay
        layout.append((name, key, buckets))
    spark.createDataFrame(layout, "name string, key string, buckets int").coalesce(1).write.mode("overwrite").parquet(f"{path}/layout_keys")


def _bucketed(spark: SparkSession, path: str, name: str, key: str, buckets: int) -> DataFrame:
    schema = spark.read.parquet(f"{path}/{name}").schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    table, where = _name(name), f"{path}/{name}".replace("'", "\\'")
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{where}'")
    return spark.table(table)


def load(spark: SparkSession, path: str, settings: Settings | None = None) -> RepoGraph:
    """The graph that save wrote."""
    keys = {r.name: r for r in spark.read.parquet(f"{path}/layout_keys").collect()}
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    there = {s.getPath().getName() for s in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)}
    tables = {
        f.name: _bucketed(spark, path, f.name, keys[f.name].key, keys[f.name].buckets) if f.name in keys else spark.read.parquet(f"{path}/{f.name}")
        for f in fields(RepoGraph)
        if f.name in there
    }
    return RepoGraph(**tables, settings=settings or Settings())
