"""Keeps the derived tables of a history up to date, by increment.

    python -m jobs.job1_history_update INPUT OUTPUT [--config jobs/config/job1_history_update.json]

Reads the commits above the high-water mark (orders with their lines, by o_orderkey; the filter reaches both scans), adds their
states under OUTPUT/states, and replaces the partitions of OUTPUT/owners, churn and author_modules whose modules these commits
touched, and the small tables authors and coupled. A run without new commits writes nothing. A run that was interrupted leaves no
mark: the next one does its batch again and replaces whatever it left. Numbers of new commits must be above all earlier ones, and
a commit's lines must be there when it is.
"""

from __future__ import annotations

import logging
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.plans import increment, proxy
from lodestrata.plans.graph import Settings
from lodestrata.runtime import shared_dir

from .runner import main

log = logging.getLogger("jobs.history_update")
DEFAULTS: dict[str, Any] = {"as_of": proxy.AS_OF, "half_life_days": 180.0, "max_files_per_commit": 10}


def run(spark: SparkSession, source: str, output: str, config: dict[str, Any] | None = None) -> dict[str, int]:
    """One run: batch, commits and modules it has written."""
    config = DEFAULTS | (config or {})
    settings = Settings(half_life_days=config["half_life_days"], max_files_per_commit=config["max_files_per_commit"])
    done, high = increment.last_mark(spark, output)
    log.info("reading commits above %s from %s (%d batches done)", high, source, done)
    found = increment.update(
        spark, output, lambda mark: proxy.graph(spark, source, settings, after=mark), F.col("hash").cast("long"), config["as_of"]
    )
    log.info("batch %d: %d commits read, %d modules written to %s", found["batch"], found["commits"], found["modules"], output)
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The churn of all files after two runs into one new folder; the second finds nothing new."""
    output = f"{shared_dir(spark)}/jobs/history-update-{uuid.uuid4().hex}"
    for _ in range(2):
        run(spark, sf_dir, output)
    churn = increment.churn_at(spark, output, DEFAULTS["as_of"], DEFAULTS["half_life_days"])
    return churn.select(
        "module", "path", "commit_count", "author_count", "additions", "deletions", "first_ts", "last_ts", "top_author",
        F.round("top_share", 6).alias("top_share"), F.round("recent", 6).alias("recent"),
    )


SQL = f"""WITH {proxy.duckdb_ctes()},
shares AS (SELECT path, author_email, count(*) AS n, sum(m.additions) AS additions, sum(m.deletions) AS deletions, min(timestamp) AS a, max(timestamp) AS b,
  sum(exp(-((epoch(TIMESTAMP '{proxy.AS_OF}') - epoch(ts)) / 86400.0) / 180.0)) AS w FROM modified m JOIN commit c USING (hash) GROUP BY 1, 2)
SELECT f.module, path, CAST(sum(n) AS BIGINT) AS commit_count, count(*) AS author_count, CAST(sum(additions) AS BIGINT) AS additions,
  CAST(sum(deletions) AS BIGINT) AS deletions, min(a) AS first_ts, max(b) AS last_ts, first(author_email ORDER BY n DESC, author_email) AS top_author,
  round(max(n) / sum(n), 6) AS top_share, round(sum(w), 6) AS recent
FROM shares JOIN file f USING (path) GROUP BY f.module, path"""

if __name__ == "__main__":
    main("history-update", __doc__.split("\n")[0], DEFAULTS, run)
