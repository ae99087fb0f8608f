"""Substring search by posting lists of character trigrams.

A text that holds a term holds each of the term's trigrams. Posting lists name the rows of each trigram; a search intersects those
of its term, which are a few partitions and row groups of the index, and verifies the rows left. Upper and lower case are equal.

Lists are cut into blocks of ids, so that no list holds more than 2^bits of them, however common its trigram is.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import contains_ci

#: Partitions of an index, by the crc32 of the trigram: fixed, as searches compute them too.
SHARDS = 32
#: A block has the ids that agree but for their last BITS bits.
BITS = 12
#: A written index, of one batch or of a folder of them.
SCHEMA = "gram string, block long, n long, ids array<long>, batch int, shard int"


def grams(text: Column) -> Column:
    """The distinct trigrams of lower-cased text; none for a null or shorter one."""
    chars = F.split(F.lower(text), "")
    second, third = (F.slice(chars, F.lit(k), F.size(chars)) for k in (2, 3))
    pairs = F.zip_with(chars, second, lambda a, b: F.concat(a, b))  # null where one has ended
    return F.array_distinct(F.array_compact(F.zip_with(pairs, third, lambda a, b: F.concat(a, b))))


def row_id(key: Column, kind: str) -> Column:
    """A row's number: its key if that is one, else a hash of it. Rows that share a hash are told apart when they are verified."""
    return key.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key)


def _id(rows: DataFrame, key: str) -> Column:
    return row_id(rows[key], dict(rows.dtypes)[key])


def hashed_bits(n: int) -> int:
    """The bits of blocks for n hashed ids, which spread over all of 64 bits: about 2^BITS ids a block."""
    return min(63, 64 - max(0, n.bit_length() - BITS))


def postings(rows: DataFrame, key: str, text: str, bits: int = BITS) -> DataFrame:
    """shard, gram, block, n, ids: the sorted distinct ids of the rows that hold a trigram, by blocks of ids.

    Rows without a key or with a text of less than three characters have none.
    """
    found = rows.where(rows[key].isNotNull()).select(_id(rows, key).alias("id"), F.explode(grams(rows[text])).alias("gram"))
    lists = found.groupBy("gram", F.shiftright("id", bits).alias("block")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    shard = (F.crc32(F.col("gram").cast("binary")) % SHARDS).cast("int")
    return lists.select(shard.alias("shard"), "gram", "block", F.size("ids").cast("long").alias("n"), "ids")


def write(lists: DataFrame, path: str) -> None:
    """Lists as Parquet, a folder for each shard, dealt by ranges of trigrams so that a search skips files and row groups."""
    sorted_ = lists.repartitionByRange("shard", "gram", "block").sortWithinPartitions("shard", "gram", "block")
    sorted_.write.mode("overwrite").partitionBy("shard").parquet(path)


def candidates(lists: DataFrame, term: str) -> DataFrame:
    """id of the rows that hold all trigrams of a term of three characters or more: reads their lists only."""
    low = term.lower()
    wanted = sorted({low[i : i + 3] for i in range(len(low) - 2)})
    shards = sorted({zlib.crc32(g.encode()) % SHARDS for g in wanted})
    few = lists.where(F.col("shard").isin(shards) & F.col("gram").isin(wanted)).select("gram", F.explode("ids").alias("id"))
    return few.groupBy("id").agg(F.countDistinct("gram").alias("k")).where(F.col("k") == len(wanted)).select("id")


def find(rows: DataFrame, lists: DataFrame, key: str, text: str, term: str) -> DataFrame:
    """The rows whose text holds term, whatever the case. A term of less than three characters has no trigram, so all rows are
    read for it; the empty term is in every text but null."""
    if len(term) < 3:
        return rows.where(contains_ci(rows[text], term))
    hits = candidates(lists, term).withColumnRenamed("id", "_hit")
    return rows.join(hits, _id(rows, key) == hits["_hit"], "left_semi").where(contains_ci(rows[text], term))
