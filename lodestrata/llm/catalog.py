"""The registered corpus queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, decontaminate, exact_dedup, language, lines, paragraphs, periodic, pii, secrets, simhash, suffixes, toxicity
from .common import documents, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 100-byte strings that start earlier."""
    found = suffixes.remove_repeats(documents(spark, sf_dir))
    size = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        size.alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document, learned from labelled rows that are not held out."""
    docs, held = documents(spark, sf_dir), toxicity.held_out()
    model = toxicity.train(docs.where(~held), table(spark, sf_dir, "labels").where(~held))
    scored = toxicity.score(docs.select("doc_id", held.alias("held_out"), "text"), model).drop("text")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of every document that repeat an earlier one, long lines cut into sentences; and the whole lines."""
    found = paragraphs.repeated_paragraphs(documents(spark, sf_dir))
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("removed").cast("long").alias("n_removed"),
        "removed",
        F.array_sort(F.array_union("removed.keep_id", "removed_lines.keep_id")).alias("keep_ids"),
        F.size("removed_lines").cast("long").alias("n_removed_lines"),
        "removed_lines",
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item that a document holds within its error budget."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontaminate.matches(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.inline("matches"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows that are not held out."""
    docs = documents(spark, sf_dir)
    trees = language.train(docs.where(~language.held_out()))
    held = docs.select("doc_id", language.held_out().alias("held_out"), "text")
    return language.identify(held, trees).drop("text")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digest_columns(pii.spans(documents(spark, sf_dir).select("doc_id", "text")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document, scanned once for each distinct content."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").alias("path"), "text")
    ledger = secrets.BlobLedger(spark)
    ledger.update(docs)
    return secrets.digest_columns(ledger.findings(docs))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    return simhash.near_duplicates(documents(spark, sf_dir)).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts, white space folded, and whether it is the row that stays."""
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document and their decoded bytes, as digests."""
    bpe = byte_bpe.ByteBPE(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    coded = bpe.round_trip(documents(spark, sf_dir).select("doc_id", "text"))
    return coded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document's words, some of which the contract repeats, and what is left without their copies."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return periodic.digest_columns(periodic.with_runs(docs.withColumn("text", periodic.repeated_words(F.col("text"), F.col("doc_id")))))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without lines that five documents hold, which stay in the last of these."""
    found = lines.keep_bitmaps(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_lines",
        lines.n_dropped(F.col("keep")).alias("n_dropped"),
        F.sha2(lines.kept_text(F.col("text"), F.col("keep")), 256).alias("kept_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_dedup": op1_suffix_dedup,
        "op2_toxicity": op2_toxicity,
        "op3_paragraph_dedup": op3_paragraph_dedup,
        "op4_decontaminate": op4_decontaminate,
        "op5_language_id": op5_language_id,
        "op6_pii": op6_pii,
        "op7_secret_scan": op7_secret_scan,
        "op8_simhash_dedup": op8_simhash_dedup,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_line_dedup": op12_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_secret_scan": secrets.SQL, "op9_exact_dedup": exact_dedup.SQL, "op12_line_dedup": lines.SQL}
