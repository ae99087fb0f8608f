"""Sessions' shared storage, and the package's sources for the executors' Python workers."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


#: Bytes of an Arrow batch, unless the session has its own value: a task holds a batch several times over, in the JVM's
#: buffers and in Python's.
ARROW_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "8m"


#: Rows and characters of a batch that Python gives back, where one row does not hold more by itself.
BATCH_ROWS, BATCH_CHARS = 10_000, 2 << 20


def batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """rows in batches of bounded size: one for each row costs more than what most rows hold."""
    some: list[tuple] = []
    chars = 0
    for row in rows:
        some.append(row)
        chars += sum(len(v) for v in row if isinstance(v, str))
        if len(some) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)
            some, chars = [], 0
    if some:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


#: Tasks for each core in work that a table's bytes say nothing of.
TASKS_PER_CORE = 4


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by a key to a few tasks for each core, however few partitions it comes in and however few bytes it has: a small file
    is one partition, and texts that compress well are far larger in a task than what Spark coalesces partitions by."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, key)


def ship(spark: SparkSession) -> None:
    """Sends the package's sources with the application, once; Spark serves them to every executor. Bounds Arrow batches."""
    context = spark.sparkContext
    if spark.conf.get(ARROW_BYTES) == f"{64 << 20}b":  # Spark's default
        spark.conf.set(ARROW_BYTES, BATCH_BYTES)
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for source in sorted(root.rglob("*.py")):
            z.write(source, source.relative_to(root.parent))
    context.addPyFile(str(to))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share. Where it is unset, a temporary one is set if driver and
    executors are one process; on a cluster that is an error."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lodestrata-"))
        found = context.getCheckpointDir()
    return found


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{_own_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def _filesystem(spark: SparkSession, path: str):
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def children(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder of any store that Spark reads; none if it does not exist."""
    fs, at = _filesystem(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def mark(spark: SparkSession, path: str) -> None:
    """Makes an empty file, which either is there as a whole or not."""
    fs, at = _filesystem(spark, path)
    fs.create(at, True).close()


def clear(spark: SparkSession) -> None:
    """Removes the tables that this application has written between steps; what was computed from them is to be saved before."""
    fs, at = _filesystem(spark, _own_dir(spark))
    fs.delete(at, True)


def written(df: DataFrame, tag: str, path: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or fresh_path(spark, tag)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
