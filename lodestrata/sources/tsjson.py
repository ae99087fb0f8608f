"""What an external analyzer of TypeScript and JavaScript found, as JSON documents: functions, calls and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import shortened
from .pysource import SOURCE_LENGTH, SOURCE_MARK

SCHEMA = """functions array<struct<id:string,path:string,name:string,qualname:string,language:string,start_line:int,end_line:int,
is_exported:boolean,is_method:boolean,source:string,complexity:int>>,
calls array<struct<caller_id:string,callee_id:string,confidence:string,resolution:string,line:int>>,
imports array<struct<from_path:string,to_path:string,imported_names:array<string>>>"""


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """functions (the last of an id wins, sources shortened), call sites with pos, and imports."""
    docs = spark.read.schema(SCHEMA).option("multiLine", "true").json(path)
    rows = docs.select(F.posexplode("functions").alias("pos", "f")).groupBy("f.id").agg(F.max_by("f", "pos").alias("f")).select("f.*")
    source = shortened(F.col("source"), SOURCE_LENGTH, SOURCE_MARK)
    calls = docs.select(F.posexplode("calls").alias("pos", "c")).select("c.*", F.col("pos").cast("long").alias("pos"))
    return {"functions": rows.withColumn("source", source), "calls": calls, "imports": docs.select(F.inline("imports"))}
