"""What the corpus operators share: table access, shared storage, sized joins and components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..runtime import fresh_path, shared_dir, ship, written

__all__ = ["fresh_path", "shared_dir", "ship", "written"]

#: Bytes of a column that are worked on at once in Python.
PART_BYTES = 1 << 20
#: The six ASCII white-space characters as a Java and Python character class.
ASCII_SPACE = r"[ \t\n\x0B\f\r]+"
#: Rows up to which a two-column key table (at most about 100 bytes a row) is broadcast.
BROADCAST_ROWS = 200_000
#: Rows of one key that one task may get in a join.
HOT_ROWS = 10_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def given_back(mapped: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """mapped, which at a task's end returns the memory that its allocators hold: the worker process goes on living, and
    what it keeps is missing to the executor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from mapped(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only the GNU library has it
                ctypes.CDLL(None).malloc_trim(0)

    return run


def with_mapped(
    docs: DataFrame,
    source: str,
    ddl: str,
    make: Callable[[], Callable[[pa.Array], list[pa.Array]]],
    done: Callable[[], None] = lambda: None,
) -> DataFrame:
    """docs with new columns (ddl) that are computed from the column source, in Python, over Arrow batches.

    make is called once in each task; what it returns gets a part of source at a time and gives the new columns. Parts
    are of about PART_BYTES, so that neither they nor what is made of them grow with the size of a batch. done is called
    at a task's end, to give back what the worker process, which goes on living, would else keep.
    """
    ship(docs.sparkSession)
    new = T.StructType.fromDDL(ddl)
    at, schema = docs.columns.index(source), T.StructType([*docs.schema, *new])

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        try:
            for batch in batches:
                column = batch.column(at)
                rows = max(1, batch.num_rows * PART_BYTES // max(1, column.nbytes))
                for start in range(0, max(1, batch.num_rows), rows):
                    part = batch.slice(start, rows)
                    made = [x.cast(k) for x, k in zip(compute(part.column(at)), kinds)]
                    yield pa.RecordBatch.from_arrays([*part.columns, *made], schema.names)
        finally:
            done()

    kinds = [to_arrow_type(f.dataType) for f in new]
    return docs.mapInArrow(given_back(mapped), schema)


def tidy(spark: SparkSession) -> None:
    """Has Spark remove the shuffle files of plans that nobody holds any more, which it does when the driver collects garbage:
    rarely, if the driver has little to do."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def sized(keys: DataFrame, rows: int | None = None) -> DataFrame:
    """keys (a written table), with a broadcast hint only if it is counted to be small."""
    n = keys.count() if rows is None else rows
    return F.broadcast(keys) if n <= BROADCAST_ROWS else keys


def without_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is not in ids; rows without a key stay."""
    gone = written(ids.select(key).distinct(), "gone")
    return docs.join(sized(gone), key, "left_anti").select(*docs.columns)


def fold(key: Column | str, n: int) -> Column:
    """crc32 of the key as text, modulo n: the contract's split of rows into folds; -1 for a null key."""
    place = F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")) % n
    return F.coalesce(place, F.lit(-1))


def hashed_sample(rows: DataFrame, group: str, n: int, size: str | None = None, most: int = 0, once: bool = False) -> DataFrame:
    """At most n rows of each group: those with the smallest hashes of all their columns; with size, up to the first whose sizes
    sum up to more than most; with once, equal rows count as one. rows should be narrow: keys and hashes of what they stand for.

    Equal rows are folded first. What is left has different hashes, so a threshold that leaves about twice n of them bounds
    what is ranked together, however large the table is and however often its keys are repeated.
    """
    folded = rows.groupBy(*rows.columns).agg((F.lit(1) if once else F.count("*")).cast("long").alias("_times"))
    folded = written(folded.withColumn("_hash", F.xxhash64(*rows.columns)), "sample-rows")
    counts = written(folded.groupBy(group).agg(F.count("*").alias("_n")), "group-sizes")
    place = F.pmod(F.col("_hash"), F.lit(1 << 31)) / float(1 << 31)
    thin = folded.join(sized(counts), folded[group].eqNullSafe(counts[group])).drop(counts[group]).where(place * F.col("_n") < 2 * n + 50).drop("_n")
    order = Window.partitionBy(group).orderBy(place, "_hash", *[c for c in rows.columns if c != group])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = thin.withColumn("_take", F.least("_times", F.lit(n) - F.coalesce(F.sum("_times").over(before), F.lit(0))))
    if size:
        sums = F.sum(F.col(size) * F.col("_times")).over(order.rowsBetween(Window.unboundedPreceding, 0))
        ranked = ranked.withColumn("_sum", sums).where(F.col("_sum") <= most)
    taken = ranked.where(F.col("_take") > 0).withColumn("_take", F.explode(F.sequence(F.lit(1).cast("long"), "_take")))
    return taken.select(*rows.columns)


def count_kind(spans: Column, kind: str) -> Column:
    """How many of array<struct<kind,start,end>> are of kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined_spans(spans: Column) -> Column:
    """array<struct<kind,start,end>> as kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def lookup(rows: DataFrame, keys: DataFrame, on: str, how: str = "inner", n: str = "n", total: int | None = None) -> DataFrame:
    """rows joined with keys (unique in on; their column n tells how many rows have the key).

    Keys of more than HOT_ROWS rows, or so many more that at most BROADCAST_ROWS of total rows' keys can be such, are
    broadcast, so that no task gets all rows of one. The others are joined by a shuffle.
    """
    total = rows.count() if total is None else total
    often = max(HOT_ROWS, total // BROADCAST_ROWS)
    hot, cold = F.broadcast(keys.where(F.col(n) > often)), keys.where(F.col(n) <= often)
    return rows.join(hot, on).unionByName(rows.join(hot.select(on), on, "left_anti").join(cold, on, how))


def salted(rows: DataFrame, keys: DataFrame, on: str, how: str = "inner", n: str = "n", total: int | None = None) -> DataFrame:
    """rows joined with keys as by lookup, whatever keys carry: only the hot ones' keys and numbers of parts are broadcast. Their
    rows are dealt to as many parts, which all get what the key carries, in one join by a shuffle."""
    total = rows.count() if total is None else total
    often = max(HOT_ROWS, total // BROADCAST_ROWS)
    parts = F.ceil(F.col(n) / often).cast("long")
    hot = keys.where(F.col(n) > often).select(on, parts.alias("_parts"))
    salt = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_parts")), F.lit(0)).cast("long")
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_parts")
    wide = keys.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1).cast("long")) - 1)))
    return dealt.join(wide, [on, "_salt"], how).drop("_salt")


#: Bytes of lists that are broadcast.
BROADCAST_BYTES = 64 << 20


def sized_lists(keys: DataFrame, column: str, item: int) -> DataFrame:
    """keys (a written table) with lists of items of so many bytes, with a broadcast hint only if all of them are counted to be small."""
    n, items = keys.agg(F.count("*"), F.coalesce(F.sum(F.size(column)), F.lit(0))).first()
    return F.broadcast(keys) if 64 * n + item * items <= BROADCAST_BYTES else keys


def unused(docs: DataFrame, name: str) -> str:
    """name, or a longer one that no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) of every node of edges (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps, which keep connectivity and end in stars around each component's
    smallest node after O(log^2) rounds. Each round is written to shared storage. Self-loops are allowed.
    """
    nodes_type = edges.schema["a"].dataType
    original = written(edges.select("a", "b").where("a is not null and b is not null").distinct(), "edges")
    links = original.where("a <> b")

    def step(links: DataFrame, large: bool, n: int) -> DataFrame:
        low, high = F.least("a", "b"), F.greatest("a", "b")
        if large:
            arcs = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select("b", "a"))
        else:
            arcs = links.select(high.alias("u"), low.alias("v"))
        least = arcs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        found = lookup(arcs, least, "u", total=2 * n)
        if large:
            new = found.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            new = found.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
        return new.where("a <> b").distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(links)
    for _ in range(max_rounds):
        if not before[0]:
            break
        links = written(step(written(step(links, True, before[0]), "large-stars"), False, before[0]), "stars")
        now = mark(links)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    names = original.select(F.col("a").alias("node")).union(original.select("b")).distinct()
    lows = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return names.join(lows, "node", "left").select(
        "node", F.coalesce("component", "node").cast(nodes_type).alias("component")
    )
