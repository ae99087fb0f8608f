"""A corpus pipeline of five stages over `documents`.

Each stage takes what its predecessor kept, written as Parquet and read again: language identification (documents
without a letter go), exact deduplication, SimHash near-deduplication (the smallest doc_id of each group stays),
benchmark decontamination (documents that hold an item go), and byte-level BPE. All but the last return the columns of
documents. Rows that repeat a doc_id, or have none, are decided on one by one. SQL cannot express the first stage, so there is no oracle; a test compares with brute force.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.llm import byte_bpe, decontaminate, exact_dedup, language, simhash
from lodestrata.llm.common import documents, sized, table, unused, without_ids, written

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; null, empty and letterless texts go. Learned from the labelled rows of docs; without
    any, all go. Rows are decided on one by one, whatever their doc_id; other columns may have any name. An empty table
    stays empty, here and in all stages."""
    to, score = unused(docs, "language"), unused(docs, "language_score")
    found = language.identify(docs, language.train(docs), to=to, score=score)
    return found.where(F.col(to) != language.UNDETERMINED).select(*docs.columns)


def first_rows(docs: DataFrame, found: DataFrame, key: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows of docs that stay by found (doc_id, key, group, stays), which has a row for each of docs.

    A doc_id that one row has decides for it. Of rows that share a doc_id or have none, the ones to stay are found by doc_id
    and key (docs, name -> docs with its key), and of those of a group the first one stays. Only these rows are numbered.
    """
    found = written(found, "pipeline-found")
    many = written(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-repeated")
    many = sized(many)
    out = without_ids(docs, found.where("not stays")).where("doc_id is not null").join(many, "doc_id", "left_anti").select(*docs.columns)
    odd = docs.where("doc_id is null").unionByName(docs.join(many, "doc_id", "left_semi").select(*docs.columns))
    to, row = unused(docs, "key"), unused(docs, "row")
    odd = written(key(odd, to).withColumn(row, F.monotonically_increasing_id()), "pipeline-rows")
    decided = found.where("stays").select(F.col("doc_id").alias("_doc_id"), F.col("key").alias("_key"), F.col("group").alias("_group")).distinct()
    same = odd["doc_id"].eqNullSafe(decided["_doc_id"]) & (odd[to] == decided["_key"])
    first = odd.select("doc_id", to, row).join(decided, same).groupBy("_group").agg(F.min(row).alias("_first"))
    first = written(first.select("_first"), "pipeline-first")
    return out.unionByName(odd.join(sized(first), odd[row] == first["_first"], "left_semi").select(*docs.columns))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for their white space, the one with the smallest doc_id; null texts are empty ones.
    Of rows with that doc_id, and where all doc_ids are null, one row stays."""
    found = exact_dedup.exact_duplicates(docs.select("doc_id", "text"))
    sha = lambda rows, to: rows.withColumn(to, F.sha2(exact_dedup.normalised(rows["text"].cast("string")), 256))
    return first_rows(docs, found.select("doc_id", F.col("text_sha256").alias("key"), F.col("text_sha256").alias("group"), F.col("kept").alias("stays")), sha)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked, the one with the smallest doc_id, and one row of those with it. Null and
    blank texts have one fingerprint. A row that is linked to none stays, whatever its doc_id."""
    found = simhash.near_duplicates(docs.select("doc_id", "text"))
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("stays")
    return first_rows(
        docs, found.select("doc_id", F.col("fp").alias("key"), F.col("component").alias("group"), stays), lambda rows, to: simhash.fingerprints(rows, to=to)
    )


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, and without items all stay. Rows are decided
    on one by one."""
    to = unused(docs, "matches")
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"), to=to)
    return found.where(F.size(to) == 0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian 32-bit integers), and whether they decode to the text, a row for each of docs.
    Null texts are empty and have no ids."""
    bpe = byte_bpe.ByteBPE(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.round_trip(docs.select("doc_id", "text"))
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        "ids",
        (F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")).alias("exact"),
    )


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("simhash_dedup", near),
    ("decontaminate", clean),
    ("byte_bpe", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
