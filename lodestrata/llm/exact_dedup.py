"""Exact deduplication with a log-structured merge index of content digests.

A batch of rows is flushed as a run of the next generation: digests, sorted in each memtable (one for each task). Compaction
merges the run with the level of the former generation into a new one that keeps, for each digest, the smallest
identifier, the number of rows and the generation that last touched it. A level has a filter, bitmaps of hashed digests:
only digests that pass it are looked up in the level, and only what they hit is merged; the rest is copied in its order.

Every hit is verified byte by byte against the text of the digest's entry: of the row that stays, or where an earlier
generation made the entry, of a stored text. Rows whose bytes differ get another digest, made of the text with a mark before
it, and are merged and verified anew. A generation counts once its mark is written, last of all; what a lost driver left of an
unfinished one is overwritten.

Native: DataFrame operations only. Texts are shuffled only for hits, never for rows that are alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import children, mark
from .common import ASCII_SPACE, BROADCAST_ROWS, fresh_path, lookup, sized, written

#: Hits on one entry that one task verifies; larger groups are dealt to more copies of its text.
HITS_PER_SALT = 256
#: Bits of a level's filter for each digest in it.
BITS_PER_DIGEST = 8
#: Bitmaps of a filter (4 KB each) up to which it is broadcast.
BROADCAST_BITMAPS = 4096
RUN, LEVEL = "doc_id long, sha binary, digest binary", "digest binary, keep_id long, n long, generation long"


def normalised(text: Column) -> Column:
    """Null as empty; each run of ASCII white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), ASCII_SPACE, " ")


class DigestIndex:
    """An index under path: runs, levels, filters, texts and marks by generation. Opened anew, it goes on after its last one.

    Without a path it serves one batch and stores no texts. digest_bytes shortens digests (for tests of collisions); 32 is
    the whole SHA-256.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, digest_bytes: int = 32):
        self.spark, self.stored = spark, path is not None
        self.path = path or fresh_path(spark, "digest-index")
        self.digest_bytes = digest_bytes

    @property
    def generation(self) -> int:
        """The last finished one; 0 for none."""
        return max((int(n.partition("=")[2]) for n in children(self.spark, f"{self.path}/marks")), default=0)

    def _at(self, part: str, generation: int) -> str:
        return f"{self.path}/{part}/generation={generation}"

    def digests(self, docs: DataFrame) -> DataFrame:
        """doc_id, text, sha, digest: texts normalised."""
        sha = F.unhex(F.sha2("text", 256))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), normalised(F.col("text").cast("string")).alias("text"))
        return rows.withColumn("sha", sha).withColumn("digest", F.substring("sha", 1, self.digest_bytes))

    def flush(self, rows: DataFrame, generation: int) -> DataFrame:
        """The rows' digests as a run, sorted in each memtable."""
        run = rows.select("doc_id", "sha", "digest").sortWithinPartitions("digest", "doc_id")
        return written(run, "run", self._at("runs", generation))

    def level(self, generation: int) -> DataFrame:
        return self.spark.read.schema(LEVEL).parquet(self._at("level", generation))

    def _passed(self, digests: DataFrame, generation: int) -> DataFrame:
        """digests without those that the filter of a generation's level rules out."""
        filters = self.spark.read.schema("bucket long, bitmap binary, bits long").parquet(self._at("filter", generation))
        rows, bits = filters.agg(F.count("*"), F.max("bits")).first()
        if not rows:
            return digests.limit(0)
        filters = filters.select("bucket", "bitmap")
        slot = F.pmod(F.xxhash64("digest"), F.lit(bits))
        at = digests.withColumns({"bucket": F.bitmap_bucket_number(slot), "_bit": F.bitmap_bit_position(slot)})
        found = at.join(F.broadcast(filters) if rows <= BROADCAST_BITMAPS else filters, "bucket")
        byte = F.conv(F.hex(F.expr("substring(bitmap, cast(_bit div 8 + 1 as int), 1)")), 16, 10).cast("int")
        # a constant shift is all that the function takes, so the byte is divided instead
        return found.where(F.floor(byte / F.pow(F.lit(2), F.col("_bit") % 8)) % 2 == 1).select(*digests.columns)

    def compact(self, run: DataFrame, generation: int) -> DataFrame:
        """Merges a run with the former level to the level of its generation, with a filter."""
        new = run.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("n"))
        new = new.withColumn("generation", F.lit(generation).cast("long"))
        if generation > 1:
            former = self.level(generation - 1)
            new = written(new, "new-digests")
            maybe = written(self._passed(new, generation - 1), "passed")
            old = former.select("digest", F.col("keep_id").alias("old_id"), F.col("n").alias("old_n"))
            hits = written(old.join(sized(maybe), "digest").withColumn("keep_id", F.least("old_id", "keep_id")), "hits")
            hit = sized(hits.select("digest"))
            touched = hits.select("digest", "keep_id", (F.col("n") + F.col("old_n")).alias("n"), "generation")
            fresh = new.join(hit, "digest", "left_anti").union(touched)
            kept = former.join(hit, "digest", "left_anti").select("digest", "keep_id", "n", "generation")
            new = kept.union(fresh)
        level = written(new.sortWithinPartitions("digest"), "level", self._at("level", generation))
        bits = max(1, level.count()) * BITS_PER_DIGEST
        slot = F.pmod(F.xxhash64("digest"), F.lit(bits).cast("long"))
        bitmaps = level.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap"))
        written(bitmaps.withColumn("bits", F.lit(bits).cast("long")), "filter", self._at("filter", generation))
        return level

    def store(self, rows: DataFrame, generation: int) -> None:
        """The texts of a generation, for verification by later ones, and its mark."""
        if self.stored:
            rows.select("digest", "text").write.mode("overwrite").parquet(self._at("texts", generation))
        mark(self.spark, f"{self.path}/marks/generation={generation}")

    def texts(self, generation: int, digests: DataFrame) -> DataFrame:
        """digest, text of digests that generations before this one have stored."""
        paths = [self._at("texts", g) for g in range(1, generation)]
        stored = self.spark.read.schema("digest binary, text string").parquet(*paths)
        return stored.join(digests, "digest", "left_semi").groupBy("digest").agg(F.min("text").alias("text"))


def exact_duplicates(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs (doc_id, text; other columns are ignored).

    Groups are those of the index after docs were added: with an index of earlier batches, keep_id may be a row of these, and
    group_size counts them; rows of earlier batches are not given again. Null and empty texts are equal, as are texts of
    white space only and one space. Rows that repeat a doc_id count in group_size each, and stay or go together if their
    texts are equal. A null doc_id is kept only if its whole group has none. An empty table gives an empty result.
    """
    index = index or DigestIndex(docs.sparkSession)
    generation = index.generation + 1
    if generation > 1 and not index.stored:
        raise ValueError("an index without a path serves one batch")
    rows = index.digests(docs)
    while True:
        run = index.flush(rows, generation)
        level = index.compact(run, generation).where(F.col("generation") == generation)
        wrong = _unequal(rows, level, index, generation)
        if wrong is None:
            break
        rows = _redigested(rows, wrong)
    index.store(rows, generation)
    return lookup(run, level, "digest").select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def _unequal(rows: DataFrame, level: DataFrame, index: DigestIndex, generation: int) -> DataFrame | None:
    """digest, text of hits whose bytes differ from their entry's text, as a written table; None if there are none."""
    shared = level.where("n > 1").select("digest", "keep_id", "n")
    some = shared.count()
    if not some:
        return None
    shared = sized(shared, some)
    if some <= BROADCAST_ROWS:
        found = rows.join(shared, "digest")
    else:
        found = lookup(rows, shared, "digest", total=shared.agg(F.sum("n")).first()[0])
    found = written(found.select("doc_id", "digest", "keep_id", "n", "text"), "hit-texts")
    own = found.where(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest").agg(F.min("text").alias("text"))
    if generation > 1:
        stored = written(index.texts(generation, shared.select("digest")), "stored-texts")
        own = own.join(stored, "digest", "left_anti").union(stored)
    salts = F.ceil(F.col("n") / HITS_PER_SALT).cast("long")
    entries = own.join(shared, "digest").select(
        F.col("digest"), F.col("text").alias("kept_text"), F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt")
    )
    checked = (
        found.withColumn("salt", F.pmod(F.xxhash64("doc_id"), salts))
        .join(entries, ["digest", "salt"])
        .where("text <> kept_text")
        .select("digest", "text")
        .distinct()
    )
    wrong = written(checked, "unequal")
    return None if wrong.isEmpty() else wrong


def _redigested(rows: DataFrame, wrong: DataFrame) -> DataFrame:
    """rows with another digest where (digest, text) is in wrong: of the text behind a mark and the former digest."""
    other = wrong.select(F.col("digest").alias("_digest"), F.col("text").alias("_text"))
    same = (F.col("digest") == F.col("_digest")) & (F.col("text") == F.col("_text"))
    again = F.unhex(F.sha2(F.concat(F.lit("differs ").cast("binary"), F.col("digest"), F.col("text").cast("binary")), 256))
    out = rows.join(other, same, "left").withColumn("digest", F.when(F.col("_digest").isNotNull(), again).otherwise(F.col("digest")))
    return out.select("doc_id", "text", "sha", "digest")


SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS s FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY s) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY s) AS kept, s AS text_sha256
FROM t
"""
