"""Streams with state per key: files seen before, and what each worker is doing.

State is looked up by key, so what a micro-batch reads grows with the batch and never with what came before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .events import TERMINAL

#: What a change of a worker's state may be: it works on a file, has ended one, or hasn't been heard of for too long.
CHANGES = ("working", "ended", "expired")


def first_seen(stream: DataFrame, key: str = "checksum", order: str = "event_id", at: str = "ts", keep_for: str | None = None, late: str = "10 seconds") -> DataFrame:
    """The first row of each key, in order of arrival and within a micro-batch by ``order``; null keys are left out.

    A stream in update mode, as ``into_table`` writes it. The state is an aggregate per key: the least ``order``, with the other
    columns of its row, and when the first and the last micro-batch began that the key came in. It comes out as new where these are
    the same one. Rows are reduced before they are shuffled and no row passes through Python.

    With ``keep_for``, a duration like ``30 days``, a key is forgotten once the watermark, ``late`` behind the latest time ``at``, is
    that far beyond the last row it came in, so that the state is bounded; if it comes again it counts as new. Keys then have a
    timer each.
    """
    rows = stream.where(F.col(key).isNotNull())
    if keep_for is not None:
        return _first_seen_for(rows, key, order, at, keep_for, late)
    others = [c for c in stream.columns if c not in (key, order)]
    began = F.current_timestamp()  # the micro-batch's, also where it is replayed
    least = [F.min(order).alias(order), F.min("_began").alias("_first"), F.max("_began").alias("_last")]
    if others:
        least.append(F.min_by(F.struct(*others), F.struct(F.col(order).isNull(), F.col(order))).alias("_row"))
    new = rows.withColumn("_began", began).groupBy(key).agg(*least).where("_first = _last")
    return new.select(*(F.col(f"_row.{c}").alias(c) if c in others else F.col(c) for c in stream.columns))


def _first_seen_for(rows: DataFrame, key: str, order: str, at: str, keep_for: str, late: str) -> DataFrame:
    columns, lifetime = rows.columns, int(pd.Timedelta(keep_for).total_seconds() * 1000)

    def first(_, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, last = None, state.get[0] if state.exists else 0
        known = state.exists and not state.getCurrentWatermarkMs() > last + lifetime  # rows come before timeouts
        for part in parts:
            if len(part):
                last = max(last, int(part["_at"].max().timestamp() * 1000))
            if not known and len(part):
                row = part.nsmallest(1, order)
                if best is None or row[order].iloc[0] < best[order].iloc[0]:
                    best = row
        if best is not None:
            yield best[columns]
        state.update((last,))
        state.setTimeoutTimestamp(max(last + lifetime, state.getCurrentWatermarkMs() + 1))

    timed = rows.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return timed.groupBy(key).applyInPandasWithState(first, rows.schema, "last bigint", "update", GroupStateTimeout.EventTimeTimeout)


def into_table(stream: DataFrame, table: str, checkpoint: str):
    """Append a stream of new rows to a Parquet table, once across restarts: a micro-batch that is replayed overwrites what its
    earlier try wrote. The table isn't read. Rows are written as each micro-batch gives them (update mode)."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)


def worker_changes(stream: DataFrame, silence: str | None = None, late: str = "10 seconds") -> DataFrame:
    """``(worker_id, kind, path, ts, change)``: each worker's latest event of a micro-batch, or that it fell silent.

    A worker's latest event is the largest by (ts, event_id) that ever came, however late; older ones that come late change
    nothing, nor do events without a time or an id. An event that ends a file ends the worker's state. With ``silence`` a worker
    without an event for that long expires once the time ``late`` behind the latest event of all has passed that, by a timer or,
    where its events come when it has passed already, at once. Events are dropped only that are older than both together: a
    worker whose latest one is such has expired. Spark's watermark is in whole milliseconds; ``current_workers`` settles the last one.
    """
    gap = None if silence is None else int(pd.Timedelta(silence).total_seconds() * 1000)
    rows = stream.where("ts is not null and event_id is not null")
    rows = rows.select("worker_id", "event_id", "kind", "path", F.col("ts").cast("timestamp").alias("at"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    if gap is not None:
        # Spark drops what is older than the watermark, so that stands where a worker has been silent for too long.
        rows = rows.withWatermark("at", f"{int(pd.Timedelta(late).total_seconds() * 1000) + gap} milliseconds")

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        us, event, kind, path, change = state.get if state.exists else (-(1 << 63), -(1 << 63), None, None, "ended")
        before = (us, event, change)
        if state.hasTimedOut:
            change = "expired"
        for part in parts if not state.hasTimedOut else ():
            if len(part):
                times, ids = part["us"].to_numpy(), part["event_id"].to_numpy()
                newest = np.lexsort((ids, times))[-1]
                if (times[newest], ids[newest]) > (us, event):
                    us, event, kind, path = int(times[newest]), int(ids[newest]), part["kind"].iloc[newest], part["path"].iloc[newest]
                    change = "ended" if kind in TERMINAL else "working"
        if gap is not None and change == "working":
            if us // 1000 < state.getCurrentWatermarkMs():
                change = "expired"
            else:
                state.setTimeoutTimestamp(max(us // 1000, state.getCurrentWatermarkMs() + 1))
        if (us, event, change) != before:
            state.update((us, event, kind, None if pd.isna(path) else path, change))
            yield pd.DataFrame({"worker_id": [key[0]], "kind": [kind], "path": [path], "us": [us], "change": [change]})

    timeout = GroupStateTimeout.NoTimeout if gap is None else GroupStateTimeout.EventTimeTimeout
    kept = "us bigint, event bigint, kind string, path string, change string"
    changes = rows.groupBy("worker_id").applyInPandasWithState(step, "worker_id bigint, kind string, path string, us bigint, change string", kept, "update", timeout)
    return changes.select("worker_id", "kind", "path", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "change")


def current_workers(changes: DataFrame, silence: str | None = None, late: str = "10 seconds") -> DataFrame:
    """Of the table that ``into_table`` keeps of ``worker_changes``: the workers that are at work, as ``events.worker_states`` has them.

    With the ``silence`` and ``late`` of the stream, silence is told to the microsecond: the latest event of all is in the table.
    """
    last = changes.groupBy("worker_id").agg(F.max_by(F.struct("kind", "path", "ts", "change"), F.struct("batch", "ts")).alias("last"))
    working = last.where("last.change = 'working'").select("worker_id", "last.kind", "last.path", "last.ts")
    if silence is None:
        return working
    wait = sum(pd.Timedelta(t) // pd.Timedelta("1us") for t in (silence, late))
    return working.where(F.unix_micros(F.col("ts").cast("timestamp")) + wait > changes.agg(F.max(F.unix_micros(F.col("ts").cast("timestamp")))).scalar())
