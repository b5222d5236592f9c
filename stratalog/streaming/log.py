"""The event log: a folder of Parquet files that an ingest appends its progress to and streams read as their source.

Nothing is lost when readers are slow or absent, unlike with a bounded buffer: a reader's checkpoint says how far it has come.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .events import EVENT, plain_lines

#: Events that one file may have; event ids are the file's id times this, and the stage.
STAGES = 4


def _event(stage: int, kind: Column | str, when: Column, checksum: Column, done: Column, message: Column) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.when(when, F.struct((F.col("id") * STAGES + stage).alias("event_id"), kind.alias("kind"), checksum.alias("checksum"), done.alias("bytes_done"), message.alias("message")))


def of_files(files: DataFrame, at: dt.datetime) -> DataFrame:
    """Events of ``files(id, path, checksum, bytes_total, bytes_copied, ended, message)``: hashed, copied, and how it ended.

    ``bytes_copied`` null: nothing was copied; ``ended`` null: the file is still under way. ``at`` is the time of all of them.
    """
    none = F.lit(None).cast("string")
    events = F.array(
        _event(0, "hash", F.col("checksum").isNotNull(), F.col("checksum"), F.col("bytes_total"), none),
        _event(1, "copy", F.col("bytes_copied").isNotNull(), F.col("checksum"), F.col("bytes_copied"), none),
        _event(2, F.col("ended"), F.col("ended").isNotNull(), F.col("checksum"), F.lit(None).cast("bigint"), F.col("message")),
    )
    rows = files.select("id", "path", "bytes_total", F.explode(F.array_compact(events)).alias("e"))
    named = {"ts": F.lit(at).cast("timestamp_ntz"), "worker_id": F.spark_partition_id().cast("bigint"), "path": F.col("path"), "bytes_total": F.col("bytes_total")}
    return rows.select(*(named.get(c, F.col(f"e.{c}")).alias(c) for c in (f.split()[0] for f in EVENT.split(", "))))


def append(events: DataFrame, folder: str) -> None:
    """Readers see a file once it is whole."""
    events.write.mode("append").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EVENT).parquet(folder)


def follow(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The log as a stream, from its beginning."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def lines(spark: SparkSession, folder: str):
    """The log as lines of text in the order of events, one after another."""
    return (r["line"] for r in plain_lines(read(spark, folder).orderBy("ts", "event_id")).toLocalIterator())
