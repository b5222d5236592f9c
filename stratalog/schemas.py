"""Relations of the catalogue and checks that stand in for its constraints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RUN_STATUSES = ("running", "completed", "interrupted")
FILE_STATUSES = ("pending", "extracted", "hashed", "copied", "verified", "tagged", "complete", "failed", "mismatch", "tag_failed", "duplicate", "skipped")
ERROR_STATUSES = ("failed", "mismatch", "tag_failed")
#: The query for incomplete files also leaves out ``duplicate``, which ``is_terminal`` doesn't know.
TERMINAL_STATUSES = ("complete", *ERROR_STATUSES, "skipped")
FINISHED_STATUSES = (*TERMINAL_STATUSES, "duplicate")
LEDGER_STATUSES = ("copy", "skip", "duplicate", "error")

_str, _long, _bool, _ts = T.StringType(), T.LongType(), T.BooleanType(), T.TimestampNTZType()

RUNS = T.StructType(
    [
        T.StructField("id", _str, False), T.StructField("version", _str, False), T.StructField("source", _str, False),
        T.StructField("destination", _str, False), T.StructField("algorithm", _str, False), T.StructField("workers", T.IntegerType(), False),
        T.StructField("recursive", _bool, False), T.StructField("started_at", _ts, False), T.StructField("finished_at", _ts),
        T.StructField("status", _str, False),
    ]
)

FILES = T.StructType(
    [
        T.StructField("id", _long, False), T.StructField("run_id", _str, False), T.StructField("source_path", _str, False),
        T.StructField("dest_path", _str), T.StructField("dest_rel", _str), T.StructField("checksum", _str), T.StructField("algorithm", _str),
        T.StructField("skip_reason", _str), T.StructField("status", _str, False), T.StructField("is_duplicate", _bool, False),
        T.StructField("capture_date", _ts), T.StructField("file_size", _long), T.StructField("extracted_at", _ts), T.StructField("hashed_at", _ts),
        T.StructField("copied_at", _ts), T.StructField("verified_at", _ts), T.StructField("tagged_at", _ts), T.StructField("error", _str),
        T.StructField("carried_sidecars", T.ArrayType(_str)),
    ]
)

#: Header and entry lines of a ledger in one nullable struct; ``version`` above 0 marks a header.
LEDGER_LINE = T.StructType(
    [
        T.StructField("version", T.IntegerType()), T.StructField("run_id", _str), T.StructField("tool_version", _str), T.StructField("run", _str),
        T.StructField("algorithm", _str), T.StructField("destination", _str), T.StructField("recursive", _bool), T.StructField("path", _str),
        T.StructField("status", _str), T.StructField("checksum", _str), T.StructField("verified_at", _str), T.StructField("sidecars", T.ArrayType(_str)),
        T.StructField("matches", _str), T.StructField("reason", _str),
    ]
)


def is_terminal(status):
    return status.isin(*TERMINAL_STATUSES)


def is_error(status):
    return status.isin(*ERROR_STATUSES)


def violations(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows that the catalogue's constraints forbid: ``(kind, key)``. Empty for a sound catalogue."""
    bad_file = files.where(F.col("status").isNull() | ~F.col("status").isin(*FILE_STATUSES)).select(F.lit("file status").alias("kind"), F.col("id").cast("string").alias("key"))
    bad_run = runs.where(F.col("status").isNull() | ~F.col("status").isin(*RUN_STATUSES)).select(F.lit("run status"), "id")
    stray = files.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_anti").select(F.lit("unknown run"), F.col("id").cast("string"))
    twice = runs.groupBy("id").count().where("count > 1").select(F.lit("repeated run"), "id")
    return bad_file.union(bad_run).union(stray).union(twice)
