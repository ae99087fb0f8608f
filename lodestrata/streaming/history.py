"""History as a stream: commit records into tables, windowed churn, sessions, and a sliding-window limit by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

COMMIT = """hash string, author_name string, author_email string, timestamp string, message string, log_pos long,
files array<struct<path:string,additions:bigint,deletions:bigint,change_type:string,old_path:string>>"""


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """Commit records as JSON lines in a folder."""
    return spark.readStream.schema(COMMIT).json(path)


def append_history(commits: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Appends commit and modified rows under to. Batches are written to folders of their own, so that a batch that is
    run again replaces what it wrote."""

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.dropDuplicates(["hash"])
        rows.drop("files").write.mode("overwrite").parquet(f"{to}/commit/batch={number}")
        rows.select("hash", F.inline("files")).write.mode("overwrite").parquet(f"{to}/modified/batch={number}")

    return commits.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def churn(events: DataFrame, key: str, window: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """start, key, n of events (ts, key): counts by window, for batches and streams; later than late is dropped in streams."""
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide or window), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("window.start").alias("start"), key, "n")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """start, end, key, n of events (ts, key): runs without a pause of gap or more."""
    runs = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n"))
    return runs.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def allowed(times: list[float], kept: list[float], most: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Which hits are within the limit of most hits in the seconds before them. Hits that are refused don't count."""
    kept, out = list(kept), []
    for t in times:
        kept = [k for k in kept if k > t - seconds]
        out.append(len(kept) < most)
        if out[-1]:
            kept.append(t)
    return out, kept


#: Seconds that times are moved by: a watermark begins at 0, and what is not above it is dropped.
SHIFT = 86_400


def limited(hits: DataFrame, most: int, seconds: float, late: str = "1 minute") -> DataFrame:
    """key, time, allowed of a stream of hits (key, time in seconds), with the allowed hits of the last window as state.

    A key's state goes once the watermark, which is late behind the greatest time, has passed the window of its last allowed hit:
    no later hit can meet it. Hits that are themselves behind the watermark are dropped.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        times = sorted(t for f in frames for t in f["time"])
        ok, kept = allowed(times, kept, most, seconds)
        until = int((kept[-1] + seconds + SHIFT) * 1000) + 1 if kept else 0
        if until > state.getCurrentWatermarkMs():
            state.update((kept,))
            state.setTimeoutTimestamp(until)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"key": [key[0]] * len(times), "time": times, "allowed": ok})

    timed = hits.withColumn("at", F.timestamp_seconds(F.col("time") + SHIFT)).withWatermark("at", late)
    return timed.groupBy("key").applyInPandasWithState(
        step, "key string, time double, allowed boolean", "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )
