"""Keeps a substring search index of texts up to date, as a stream of their files.

    python -m jobs.job2_search_index INPUT OUTPUT [--config jobs/config/job2_search_index.json]

Takes the files of INPUT/<table>.parquet (a file or a folder of files) that are new since the stream's checkpoint under OUTPUT, and
writes the posting lists of their texts' trigrams under OUTPUT/postings, a folder for each batch and shard. A run without new
files writes nothing. A batch that was interrupted is done again by the stream, under the same number, which replaces what is
there. Search with lodestrata.operators.trigrams.find.
"""

from __future__ import annotations

import logging
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import trigrams
from lodestrata.runtime import shared_dir

from .runner import main

log = logging.getLogger("jobs.search_index")
DEFAULTS: dict[str, Any] = {"table": "documents", "key": "doc_id", "text": "text", "bits": trigrams.BITS, "files_per_batch": 1000}


def run(spark: SparkSession, source: str, output: str, config: dict[str, Any] | None = None) -> dict[str, int]:
    """One run over all files that are new: the batches and rows that it took."""
    config = DEFAULTS | (config or {})
    path = f"{source}/{config['table']}.parquet"
    fields = spark.read.parquet(path).select(config["key"], config["text"]).schema
    files = f"{source}/{config['table']}.parque[t]"  # as a pattern, the path may be a single file too
    stream = spark.readStream.schema(fields).option("maxFilesPerTrigger", config["files_per_batch"]).parquet(files)

    def write(rows: DataFrame, batch: int) -> None:
        trigrams.write(trigrams.postings(rows, config["key"], config["text"], config["bits"]), f"{output}/postings/batch={batch}")

    log.info("reading new files of %s", path)
    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    taken = [p.numInputRows for p in query.recentProgress if p.numInputRows]
    log.info("%d rows read in %d batches, lists written to %s/postings", sum(taken), len(taken), output)
    return {"batches": len(taken), "rows": sum(taken)}


def lists(spark: SparkSession, output: str) -> DataFrame:
    """All posting lists written so far."""
    return spark.read.schema(trigrams.SCHEMA).parquet(f"{output}/postings")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All posting lists after two runs into one new folder, ids joined by commas; the second run finds no new file."""
    output = f"{shared_dir(spark)}/jobs/search-index-{uuid.uuid4().hex}"
    for _ in range(2):
        run(spark, sf_dir, output)
    return lists(spark, output).select("gram", "block", "n", F.array_join("ids", ",").alias("ids"))


SQL = f"""WITH c AS (SELECT doc_id, row_number() OVER () AS r, string_split(lower(text), '') AS cs FROM documents WHERE doc_id IS NOT NULL),
e AS (SELECT r, doc_id, unnest(cs) AS x, generate_subscripts(cs, 1) AS i FROM c),
g AS (SELECT DISTINCT doc_id, x || lead(x, 1) OVER w || lead(x, 2) OVER w AS gram FROM e WINDOW w AS (PARTITION BY r ORDER BY i))
SELECT gram, doc_id // {1 << trigrams.BITS} AS block, count(*) AS n, string_agg(doc_id, ',' ORDER BY doc_id) AS ids
FROM g WHERE gram IS NOT NULL GROUP BY 1, 2"""

if __name__ == "__main__":
    main("search-index", __doc__.split("\n")[0], DEFAULTS, run)
