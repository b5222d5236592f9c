"""Questions to the catalogue: filters, joins and aggregates over ``files`` and ``runs``.

Every operator is a lazy plan. Small sides are left to Spark's size estimates. A checksum may hold a third of all rows: what is
known of it is aggregated in parts, and rows meet it again by ``skew.with_known``, which never sends a checksum to one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import gate_reason
from ..schemas import ERROR_STATUSES, FINISHED_STATUSES
from ..skew import with_known

NO_DESTINATION = "<duplicate>"


def _of_run(files: DataFrame, run_id: str | None) -> DataFrame:
    return files.where(F.col("run_id") == run_id) if run_id else files


# Filters


def files_of_run(files: DataFrame, run_id: str) -> DataFrame:
    return files.where(F.col("run_id") == run_id).orderBy("id")


def incomplete_files(files: DataFrame, run_id: str) -> DataFrame:
    return files.where((F.col("run_id") == run_id) & ~F.col("status").isin(*FINISHED_STATUSES)).orderBy("id")


def captured_between(files: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Complete files, duplicates too, with a capture date in ``start..end``."""
    return files.where((F.col("status") == "complete") & F.col("capture_date").between(F.lit(start), F.lit(end))).orderBy("capture_date", "id")


def imported_between(files: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    return files.where(F.col("verified_at").between(F.lit(start), F.lit(end))).orderBy("verified_at", "id")


def duplicates(files: DataFrame, run_id: str | None = None) -> DataFrame:
    return _of_run(files, run_id).where("is_duplicate").orderBy("id")


def inventory(files: DataFrame) -> DataFrame:
    found = files.where((F.col("status") == "complete") & ~F.col("is_duplicate"))
    return found.select(F.coalesce("dest_rel", F.lit("")).alias("dest_rel"), "checksum", "capture_date").orderBy("dest_rel")


def skipped(files: DataFrame, run_id: str | None = None) -> DataFrame:
    return _of_run(files, run_id).where(F.col("status") == "skipped").orderBy("id")


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("id") == run_id).limit(1)


def runs_by_prefix(runs: DataFrame, prefix: str) -> DataFrame:
    """Ids that begin with ``prefix``: case doesn't count, and ``%`` and ``_`` keep their pattern meaning."""
    return runs.where(F.col("id").ilike(prefix + "%")).orderBy(F.desc("started_at"), "id")


def resolve_run(runs: DataFrame, prefix: str) -> str:
    """The one run id with this prefix; an error for none or several."""
    found = [r["id"] for r in runs_by_prefix(runs, prefix).limit(2).collect()]
    if len(found) != 1:
        raise LookupError(f"run prefix {prefix!r} is {'ambiguous' if found else 'unknown'}")
    return found[0]


def running_runs(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == "running").orderBy(F.desc("started_at"), "id")


def has_active_runs(runs: DataFrame) -> DataFrame:
    return runs.agg((F.count_if(F.col("status") == "running") > 0).alias("active"))


def date_gate(files: DataFrame, since: dt.date | None, before: dt.date | None) -> DataFrame:
    """``files`` with ``gate_reason``, null for those inside the range."""
    return files.withColumn("gate_reason", gate_reason(F.col("capture_date"), since, before))


def query_files(files: DataFrame, runs: DataFrame, captured: tuple | None = None, imported: tuple | None = None, source: str | None = None) -> DataFrame:
    """Exactly one of a capture range, an import range (pairs of days, either open) and a source."""
    if sum(x is not None for x in (captured, imported, source)) != 1:
        raise ValueError("give exactly one of captured, imported and source")
    if source is not None:
        return files_by_source(files, runs, source)
    first, last = captured or imported
    start = dt.datetime.combine(first or dt.date(1900, 1, 1), dt.time.min)
    end = dt.datetime.combine(last, dt.time.min) + dt.timedelta(days=1, seconds=-1) if last else dt.datetime.now(dt.UTC).replace(tzinfo=None)
    return captured_between(files, start, end) if captured else imported_between(files, start, end)


# Joins


def files_by_source(files: DataFrame, runs: DataFrame, source: str) -> DataFrame:
    ids = runs.where(F.col("source") == source).select(F.col("id").alias("run_id"))
    return files.join(ids, "run_id", "left_semi").orderBy("id")


def errors(files: DataFrame, runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """Files in an error status, with the source of their run."""
    bad = _of_run(files, run_id).where(F.col("status").isin(*ERROR_STATUSES))
    return bad.join(runs.select(F.col("id").alias("run_id"), F.col("source").alias("run_source")), "run_id").orderBy("id")


def duplicate_pairs(files: DataFrame, run_id: str | None = None) -> DataFrame:
    """Each duplicate with every complete original of its checksum, from whichever run."""
    dup = _of_run(files, run_id).where(F.col("is_duplicate") & F.col("checksum").isNotNull())
    dup = dup.select("checksum", F.col("id").alias("duplicate_id"), F.col("source_path").alias("duplicate_source"), F.coalesce("dest_rel", F.lit("")).alias("duplicate_dest"))
    orig = files.where(~F.col("is_duplicate") & (F.col("status") == "complete"))
    orig = orig.select("checksum", F.col("id").alias("original_id"), F.col("source_path").alias("original_source"), F.coalesce("dest_rel", F.lit("")).alias("original_dest"))
    return dup.join(orig, "checksum").orderBy("duplicate_id", "original_id")


def imported_before(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """Candidates whose source path and checksum the catalogue has already taken in."""
    done = files.where(F.col("status").isin("complete", "duplicate")).select("source_path", "checksum")
    return candidates.join(done, ["source_path", "checksum"], "left_semi")


def not_imported_before(candidates: DataFrame, files: DataFrame) -> DataFrame:
    done = files.where(F.col("status").isin("complete", "duplicate")).select("source_path", "checksum")
    return candidates.join(done, ["source_path", "checksum"], "left_anti")


def first_complete(files: DataFrame) -> DataFrame:
    """``(checksum, dest, known)``: where each checksum's first complete file lies; ``known`` is true."""
    rows = files.where((F.col("status") == "complete") & F.col("checksum").isNotNull())
    return rows.groupBy("checksum").agg(F.min_by("dest_rel", F.struct(F.col("dest_rel").isNull(), "id")).alias("dest"), F.lit(True).alias("known"))


def known_copies(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """``candidates`` with ``existing``: where the checksum's first complete file lies, null for a new checksum.

    The catalogue meets the batch's distinct checksums, both aggregated, before it meets its rows.
    """
    asked = candidates.where("checksum is not null").groupBy("checksum").agg(F.count("*").alias("n"))
    found = asked.join(first_complete(files), "checksum", "left").where("known or n > 1")  # a new checksum may be frequent too
    place = F.coalesce(F.nullif("dest", F.lit("")), F.lit(NO_DESTINATION))
    return with_known(candidates, found, "checksum", candidates.columns, counts=asked).withColumn("existing", F.when(F.col("known"), place)).drop("dest", "known")


def first_writers(files: DataFrame) -> DataFrame:
    """``files`` with ``is_first`` and ``first_id``: of equal checksums the smallest id came first. A null checksum has no copies.

    An aggregate and a join instead of a window: a checksum that a third of all rows share is neither sorted nor joined in
    one task, and checksums held once aren't brought back at all.
    """
    first = files.where("checksum is not null").groupBy("checksum").agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    first_id = F.coalesce("first_id", "id")
    return with_known(files, first, "checksum", ["id"]).withColumns({"first_id": first_id, "is_first": first_id == F.col("id")})


def backfilled_algorithm(files: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows without an algorithm take their run's."""
    of_run = runs.select(F.col("id").alias("run_id"), F.col("algorithm").alias("run_algorithm"))
    return files.join(of_run, "run_id", "left").withColumn("algorithm", F.coalesce("algorithm", "run_algorithm")).drop("run_algorithm")


def retryable(failed: DataFrame, existing: DataFrame, handled: Column) -> DataFrame:
    """Failed files whose source is still there and of a known format."""
    return failed.join(existing.select(F.col("path").alias("source_path")), "source_path", "left_semi").where(handled)


# Aggregates


def list_runs(runs: DataFrame, files: DataFrame) -> DataFrame:
    """All runs, newest first, with their number of files; files are counted before they meet the runs."""
    counts = files.groupBy(F.col("run_id").alias("id")).agg(F.count("*").alias("file_count"))
    return runs.join(counts, "id", "left").withColumn("file_count", F.coalesce("file_count", F.lit(0).cast("bigint"))).orderBy(F.desc("started_at"), "id")


def runs_summary(runs: DataFrame, files: DataFrame) -> DataFrame:
    return list_runs(runs, files).agg(F.count("*").alias("runs"), F.coalesce(F.sum("file_count"), F.lit(0)).alias("files"))


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def archive_stats(files: DataFrame, runs: DataFrame) -> DataFrame:
    status = F.col("status")
    row = files.agg(
        F.count("*").alias("total"), _count(status == "complete", "complete"), _count(F.col("is_duplicate"), "duplicates"), _count(status == "failed", "failed"),
        _count(status == "mismatch", "mismatches"), _count(status == "tag_failed", "tag_failed"), _count(status == "skipped", "skipped"),
        F.coalesce(F.sum("file_size"), F.lit(0)).alias("total_size"), F.min("capture_date").alias("earliest"), F.max("capture_date").alias("latest"),
    )
    return row.crossJoin(runs.agg(F.count("*").alias("runs")))  # one row by one row


def format_breakdown(files: DataFrame) -> DataFrame:
    """Complete originals by what follows the first dot of the whole path, most frequent first."""
    rel = F.col("dest_rel")
    rows = files.where((F.col("status") == "complete") & ~F.col("is_duplicate") & rel.contains("."))
    return rows.groupBy(F.lower(F.expr("substring(dest_rel, instr(dest_rel, '.'))")).alias("extension")).agg(F.count("*").alias("files")).orderBy(F.desc("files"), "extension")


def format_shares(files: DataFrame) -> DataFrame:
    """Breakdown with each format's percentage; the total is one row, so nothing is sorted or gathered for it."""
    parts = format_breakdown(files)
    total = parts.agg(F.sum("files").alias("all_files"))
    return parts.crossJoin(total).select("extension", "files", (100.0 * F.col("files") / F.col("all_files")).alias("percent"))


def last_run_date(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == "completed").agg(F.max("finished_at").alias("last_run"))


def error_summary(files: DataFrame, run_id: str | None = None) -> DataFrame:
    bad = _of_run(files, run_id).where(F.col("status").isin(*ERROR_STATUSES))
    return bad.agg(F.count("*").alias("total"), *(_count(F.col("status") == s, s) for s in ERROR_STATUSES))


def skip_summary(files: DataFrame, run_id: str | None = None) -> DataFrame:
    reason = F.coalesce("skip_reason", F.lit(""))
    rows = _of_run(files, run_id).where(F.col("status") == "skipped")
    return rows.agg(F.count("*").alias("total"), _count(reason.startswith("unsupported"), "unsupported"), _count(reason.startswith("previously"), "previously_imported"))


def run_summary(files: DataFrame, run_id: str | None = None) -> DataFrame:
    """Counts of one run, or by run."""
    status, dup = F.col("status"), F.col("is_duplicate")
    return _of_run(files, run_id).groupBy("run_id").agg(
        F.count("*").alias("total"), _count((status == "complete") & ~dup, "complete"), _count((status == "complete") & dup, "duplicates"),
        _count(status == "skipped", "skipped"), _count(status.isin(*ERROR_STATUSES), "errors"),
    )


def date_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("files"), F.min("capture_date").alias("earliest"), F.max("capture_date").alias("latest"))


# Latest


def latest_run(runs: DataFrame, source: str | None = None) -> DataFrame:
    """The newest completed or interrupted run, of one source or of all."""
    found = runs.where(F.col("status").isin("completed", "interrupted"))
    if source is not None:
        found = found.where(F.col("source") == source)
    return found.orderBy(F.desc("started_at"), "id").limit(1)


def latest_interrupted(runs: DataFrame) -> DataFrame:
    return running_runs(runs).limit(1)
