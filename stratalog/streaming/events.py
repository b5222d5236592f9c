"""Progress events as streams: running counters, workers' states, throttled byte progress and stateful de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENT = "event_id bigint, ts timestamp_ntz, kind string, worker_id bigint, path string, checksum string, bytes_done bigint, bytes_total bigint, message string"
TERMINAL = ("complete", "duplicate", "skip", "error")


def counters(events: DataFrame, kind: str = "kind") -> DataFrame:
    """Events so far by kind; works on a stream (update or complete mode) and on a batch alike."""
    return events.groupBy(kind).agg(F.count("*").alias("events"))


def worker_states(events: DataFrame) -> DataFrame:
    """Each worker's latest stage; workers whose latest event ends a file have none."""
    last = events.groupBy("worker_id").agg(F.max_by(F.struct("kind", "path", "ts"), F.struct("ts", "event_id")).alias("last"))
    return last.where(~F.col("last.kind").isin(*TERMINAL)).select("worker_id", "last.*")


def byte_progress(events: DataFrame, every: str = "100 milliseconds", late: str | None = None) -> DataFrame:
    """The furthest byte of each file per interval; the interval that holds the total is the final one.

    As a stream it needs ``late``: in append mode an interval comes out once, when no event of the last micro-batch is more than
    that before its end, and events of intervals that are out already are dropped.
    """
    rows = events.where("bytes_done is not null").withColumn("at", F.col("ts").cast("timestamp"))
    if late:
        rows = rows.withWatermark("at", late)
    out = rows.groupBy(F.window("at", every).alias("w"), "path").agg(F.max("bytes_done").alias("bytes_done"), F.max("bytes_total").alias("bytes_total"))
    return out.select(F.col("w.start").alias("start"), "path", "bytes_done", "bytes_total", (F.col("bytes_done") >= F.col("bytes_total")).alias("final"))


def first_of_checksum(events: DataFrame) -> DataFrame:
    """In-stream de-duplication: the first event of each checksum that the state has seen."""
    return events.where("checksum is not null").dropDuplicates(["checksum"])


def plain_lines(events: DataFrame) -> DataFrame:
    """A line of text per event."""
    return events.select(F.format_string("%s %-10s %s%s", F.date_format("ts", "HH:mm:ss"), F.upper("kind"), F.coalesce("path", F.lit("")), F.coalesce(F.concat(F.lit(": "), "message"), F.lit(""))).alias("line"))
