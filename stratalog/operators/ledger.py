"""Ledgers: runs of entries, the fold to one entry per path, and the status of a source tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SUCCESS = ("copy", "duplicate")


#: Line numbers that one task adds up: a ledger's lines are cut into parts of so many.
PART = 1 << 14


def with_runs(lines: DataFrame, ledger: str = "ledger", seq: str = "seq", part: int = PART) -> DataFrame:
    """Lines with ``run_seq``: how many headers (``version > 0``) stand at or before the line, 0 for entries before any.

    A running sum in two levels, so that one long ledger isn't one task: within parts of ``part`` line numbers, and over the
    parts' sums, of which a ledger has a row per part.
    """
    header = F.when(F.coalesce("version", F.lit(0)) > 0, 1).otherwise(0)
    cut = lines.withColumns({"_part": F.floor(F.col(seq) / part), "_header": header})
    earlier = Window.partitionBy(ledger).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(ledger, "_part").agg(F.sum("_header").alias("_n")).select(ledger, "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    upto = Window.partitionBy(ledger, "_part").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = cut.withColumn("_own", F.sum("_header").over(upto))
    return counted.join(starts, [ledger, "_part"]).withColumn("run_seq", F.col("_start") + F.col("_own")).select(*lines.columns, "run_seq")


def entries(lines: DataFrame) -> DataFrame:
    """All entries of all runs in file order."""
    return lines.where(F.coalesce("version", F.lit(0)) <= 0).orderBy("ledger", "seq")


def latest_entries(lines: DataFrame) -> DataFrame:
    """Entries of the last run of each ledger, as ``with_runs`` numbers them."""
    last = lines.groupBy("ledger").agg(F.max("run_seq").alias("run_seq"))
    return lines.join(last, ["ledger", "run_seq"], "left_semi").where(F.coalesce("version", F.lit(0)) <= 0)


def folded(entries_: DataFrame) -> DataFrame:
    """One entry per path: the last one, except that a skip never replaces a success.

    Closed form of the fold: the last entry that is not a skip if that is a success, else the last of all. Both are
    partial aggregates, so no path's history is gathered.
    """
    fields = [c for c in entries_.columns if c not in ("path", "seq")]
    row = F.struct("seq", *fields)
    both = entries_.groupBy("path").agg(F.max_by(row, "seq").alias("last"), F.max_by(F.when(F.col("status") != "skip", row), F.when(F.col("status") != "skip", F.col("seq"))).alias("firm"))
    chosen = F.when(F.col("firm.status").isin(*SUCCESS), F.col("firm")).otherwise(F.col("last"))
    return both.select("path", chosen.alias("entry")).select("path", "entry.*")


def source_status(discovered: DataFrame, skipped: DataFrame, fold: DataFrame) -> DataFrame:
    """``(bucket, path, detail)`` for every file of a source tree.

    Files that the walk skipped are unrecognised; the others go by their folded entry, and without one, or with a skip
    or an unknown status, they are unsorted. Entries whose file is gone are not reported.
    """
    joined = discovered.select("path").join(fold.select("path", "status", "destination", "matches", "reason"), "path", "left")
    bucket = F.when(F.col("status") == "copy", "SORTED").when(F.col("status") == "duplicate", "DUPLICATE").when(F.col("status") == "error", "ERRORED").otherwise("UNSORTED")
    detail = F.when(F.col("status") == "copy", F.col("destination")).when(F.col("status") == "duplicate", F.col("matches")).when(F.col("status") == "error", F.col("reason"))
    rows = joined.select(bucket.alias("bucket"), "path", detail.alias("detail"))
    return rows.unionByName(skipped.select(F.lit("UNRECOGNIZED").alias("bucket"), "path", F.col("reason").alias("detail"))).orderBy("bucket", "path")


def status_summary(status: DataFrame) -> DataFrame:
    buckets = ("SORTED", "DUPLICATE", "ERRORED", "UNSORTED", "UNRECOGNIZED")
    return status.agg(F.count("*").alias("total"), *(F.count_if(F.col("bucket") == b).alias(b.lower()) for b in buckets))


def successes(entries_: DataFrame) -> DataFrame:
    return entries_.agg(F.count_if(F.col("status") == "copy").alias("copied"))
