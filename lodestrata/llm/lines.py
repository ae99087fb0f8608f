"""Line deduplication by sorted ranges of line hashes.

Boilerplate lines are long lines that many documents hold; they stay in the last of these (the largest doc_id) only.

1. Every document's long lines become rows (document, position, 128-bit digest of the line's key), written once.
2. The rows are partitioned into ranges of digests and sorted within by digest, document (largest first) and position, so a
   digest's first row is its line's first occurrence in that order. Windows over the sorted rows stream the occurrences: no
   further shuffle or sort.
3. A digest with more than HOT_ROWS rows is dealt to several (digest, part) groups of at most about so many rows each. The first
   min_docs documents of each part are enough to tell whether there are min_docs in all, and which is the last.
4. The positions that go are gathered for each document and returned as the run lengths of its keep bitmap. Texts are not
   shuffled, unless bitmaps are laid over them and are too many to be broadcast.

Native: DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, HOT_ROWS, sized_lists, unused, written

MIN_DOCS, MIN_CHARS = 5, 40
SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(docs: DataFrame) -> Column:
    return F.coalesce(docs["text"].cast("string"), F.lit(""))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_rows(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc, tag, pos, digest of every line whose key has min_chars code points or more. The key is the line without ASCII white
    space at its ends and with A-Z lower-cased; tag tells rows apart that repeat a doc_id with other texts."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc"), F.xxhash64(_text(docs)).alias("tag"), split_lines(_text(docs)).alias("lines"))
    lines = texts.select("doc", "tag", F.posexplode("lines").alias("pos", "line")).withColumn("line", F.btrim("line", F.lit(SPACE)))
    key = F.translate("line", UPPER, LOWER)
    digest = F.substring(F.unhex(F.sha2(key, 256)), 1, 16)
    return lines.where(F.char_length("line") >= min_chars).select("doc", "tag", "pos", digest.alias("digest"))


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, hot: int = HOT_ROWS) -> DataFrame:
    """doc, tag, dropped of the documents that lose lines, as a written table; dropped is array<struct<start,end>>, sorted and
    maximal. hot bounds the rows of a digest that one task gets (for tests)."""
    rows = written(line_rows(docs, min_chars), "lines").withColumn("_h", F.xxhash64("digest"))
    counts = written(rows.groupBy("_h").agg(F.count("*").alias("n")).where(F.col("n") > hot), "hot-lines")
    # at most BROADCAST_ROWS digests can have more rows than this
    often = max(hot, rows.count() // BROADCAST_ROWS)
    parts = counts.where(F.col("n") > often).select("_h", F.ceil(F.col("n") / often).alias("parts"))
    dealt = rows.join(F.broadcast(parts), "_h", "left")
    part = F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("parts")), F.lit(0).cast("long"))
    dealt = dealt.select("digest", part.alias("part"), "doc", "tag", "pos", F.col("parts").isNotNull().alias("hot"))

    last = F.desc_nulls_last("doc")
    ranges = dealt.repartitionByRange("digest", "part").sortWithinPartitions("digest", "part", last, "pos")
    group = Window.partitionBy("digest", "part")
    stream = (
        ranges.withColumn("rank", F.dense_rank().over(group.orderBy(last)))
        .withColumn("first", F.row_number().over(group.orderBy(last, "pos")) == 1)
        .withColumn("docs", F.max("rank").over(group))  # a group has at most `often` rows
    )
    # of a line that is not hot, the first document is known by its rank
    goes = F.col("hot") | ((F.col("docs") >= min_docs) & (F.col("rank") > 1))
    kept = ("doc", "tag", "pos", "hot", "rank", F.when(F.col("hot"), F.col("digest")).alias("digest"))
    streamed = written(stream.where(goes).select(*kept), "streamed-lines")
    # of a hot one, by the first documents of its parts
    heads = streamed.where(F.col("hot") & (F.col("rank") <= min_docs)).select("digest", "doc").distinct()
    known = heads.groupBy("digest").agg(F.count("*").alias("docs"), F.max("doc").alias("top")).where(F.col("docs") >= min_docs)
    hot_ones = streamed.where("hot").join(F.broadcast(known), "digest").where(~F.col("doc").eqNullSafe(F.col("top")))
    gone = streamed.where("not hot").select("doc", "tag", "pos").union(hot_ones.select("doc", "tag", "pos"))

    places = gone.groupBy("doc", "tag").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    return written(places.select("doc", "tag", _runs(F.col("places")).alias("dropped")), "dropped-lines")


def _runs(places: Column) -> Column:
    """Sorted distinct numbers as runs [start, end): a number starts one if the one before it is not there, and ends one if the
    one after it is not."""
    before = F.concat(F.array(F.lit(None).cast("int")), places)  # as long as places but for its last, which zip_with pads
    after = F.concat(F.slice(places, 2, F.size(places)), F.array(F.lit(None).cast("int")))
    starts = F.zip_with(places, before, lambda p, b: F.when(b.isNull() | (b + 1 < p), p))
    ends = F.zip_with(places, after, lambda p, a: F.when(a.isNull() | (a - 1 > p), p + 1))
    return F.zip_with(F.array_compact(starts), F.array_compact(ends), lambda s, e: F.struct(s.alias("start"), e.alias("end")))


def keep_bitmaps(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS, hot: int = HOT_ROWS) -> DataFrame:
    """docs with n_lines and keep: run lengths of the document's bitmap of lines that stay, beginning with those that stay (0 if
    the first line goes), then those that go, and so on. Columns of these names are given as n_lines_ and keep_ if docs has them.

    Lines are split at newlines; a null or empty text is one empty line. A line goes if its key has min_chars code points or
    more, at least min_docs documents hold the key, and the document is not the one with the largest doc_id of these. Rows
    that share a doc_id are one document, each with its own bitmap; null doc_ids are one document, the smallest. An empty table
    gives an empty result. Other columns are given as they are.
    """
    dropped = sized_lists(dropped_lines(docs, min_docs, min_chars, hot), "dropped", 16)
    doc, tag, gone = (unused(docs, f"_{c}") for c in dropped.columns)
    dropped = dropped.toDF(doc, tag, gone)
    same = docs["doc_id"].cast("long").eqNullSafe(dropped[doc]) & (F.xxhash64(_text(docs)) == dropped[tag])
    n_lines = F.size(split_lines(_text(docs)))
    found = docs.join(dropped, same, "left")
    runs = F.coalesce(dropped[gone], F.expr("array()").cast("array<struct<start:int,end:int>>"))
    ends = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["end"]))
    starts = F.concat(F.transform(runs, lambda r: r["start"]), F.array(n_lines))
    stays = F.zip_with(starts, ends, lambda s, e: s - e)
    goes = F.transform(runs, lambda r: r["end"] - r["start"])
    keep = F.array_compact(F.flatten(F.zip_with(stays, goes, lambda s, g: F.array(s, g))))
    return found.select(*(docs[c] for c in docs.columns), n_lines.cast("long").alias(unused(docs, "n_lines")), keep.alias(unused(docs, "keep")))


def n_dropped(keep: Column) -> Column:
    """How many lines a keep bitmap leaves out."""
    return F.aggregate(F.transform(keep, lambda r, i: F.when(i % 2 == 1, r).otherwise(0)), F.lit(0).cast("long"), lambda n, r: n + r)


def kept_text(text: Column, keep: Column) -> Column:
    """The lines of text that stay by its keep bitmap, joined by newlines."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    flags = F.flatten(F.transform(keep, lambda r, i: F.array_repeat(i % 2 == 0, r)))
    some = F.array_join(F.zip_with(split_lines(text), flags, lambda line, stays: F.when(stays, line)), "\n")
    return F.when(F.size(keep) == 1, text).otherwise(some)


SQL = r"""
WITH l AS (
  SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), e AS (
  SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e
), often AS (
  SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), f AS (
  SELECT k.*, o.key IS NOT NULL AND k.doc_id <> o.top AS gone FROM k LEFT JOIN often o ON o.key = k.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY r, doc_id
"""
