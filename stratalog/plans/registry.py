"""Catalogue queries by name over the driver's tables, and the SQL that each is held against."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, formats, globs, hashing, paths, text, xmp
from ..operators import catalog, doctor, ledger, rules, sidecars
from ..sources import index, store
from ..streaming import events as streams
from ..streaming import state
from ..workdir import shared_folder, tables
from . import execute, ingest, progress, verify, views
from .views import CANDIDATES_SQL, FILES_SQL, LEDGER_SQL, RUNS_SQL, files, runs, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

SHORT = ("id", "run_id", "source_path", "dest_rel", "checksum", "status", "is_duplicate", "capture_date")
SHORT_SQL = ", ".join(SHORT)
START, END = dt.datetime(2021, 6, 1), dt.datetime(2022, 3, 31, 23, 59, 59)
RANGE_SQL = "BETWEEN TIMESTAMP '2021-06-01' AND TIMESTAMP '2022-03-31 23:59:59'"


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def over_files(name: str, sql: str, *columns: str):
    """A query on the files view alone."""

    def add(f: Callable[[DataFrame], DataFrame]):
        run = lambda s, d: f(files(s, d)).select(*columns) if columns else f(files(s, d))
        QUERIES[name], ORACLE_SQL[name] = run, f"WITH {FILES_SQL} {sql}"
        return f

    return add


def over_both(name: str, sql: str, *columns: str):
    """A query on files and runs."""

    def add(f: Callable[[DataFrame, DataFrame], DataFrame]):
        run = lambda s, d: f(files(s, d), runs(s, d)).select(*columns) if columns else f(files(s, d), runs(s, d))
        QUERIES[name], ORACLE_SQL[name] = run, f"WITH {FILES_SQL}, {RUNS_SQL} {sql}"
        return f

    return add


def over_runs(name: str, sql: str, *columns: str):
    def add(f: Callable[[DataFrame], DataFrame]):
        run = lambda s, d: f(runs(s, d)).select(*columns) if columns else f(runs(s, d))
        QUERIES[name], ORACLE_SQL[name] = run, f"WITH {RUNS_SQL} {sql}"
        return f

    return add


# Filters

over_files("files_by_run", f"SELECT {SHORT_SQL} FROM files WHERE run_id = 'src3'", *SHORT)(lambda f: catalog.files_of_run(f, "src3"))
over_files("incomplete_files", f"SELECT {SHORT_SQL} FROM files WHERE run_id = 'src4' AND status NOT IN ('complete', 'failed', 'mismatch', 'tag_failed', 'skipped', 'duplicate')", *SHORT)(lambda f: catalog.incomplete_files(f, "src4"))
over_files("files_by_capture_range", f"SELECT {SHORT_SQL} FROM files WHERE status = 'complete' AND capture_date {RANGE_SQL}", *SHORT)(lambda f: catalog.captured_between(f, START, END))
over_files("files_by_import_range", f"SELECT {SHORT_SQL}, verified_at FROM files WHERE verified_at {RANGE_SQL}", *SHORT, "verified_at")(lambda f: catalog.imported_between(f, START, END))
over_files("duplicates", f"SELECT {SHORT_SQL} FROM files WHERE is_duplicate", *SHORT)(catalog.duplicates)
over_files("duplicates_by_run", f"SELECT {SHORT_SQL} FROM files WHERE is_duplicate AND run_id = 'src7'", *SHORT)(lambda f: catalog.duplicates(f, "src7"))
over_files("inventory", "SELECT coalesce(dest_rel, '') AS dest_rel, checksum, capture_date FROM files WHERE status = 'complete' AND NOT is_duplicate")(catalog.inventory)
over_files("skipped", "SELECT id, source_path, skip_reason FROM files WHERE status = 'skipped'", "id", "source_path", "skip_reason")(catalog.skipped)
over_files("skipped_by_run", "SELECT id, source_path, skip_reason FROM files WHERE status = 'skipped' AND run_id = 'src3'", "id", "source_path", "skip_reason")(lambda f: catalog.skipped(f, "src3"))
over_runs("run_by_id", "SELECT * FROM runs WHERE id = 'src7'")(lambda r: catalog.run_by_id(r, "src7"))
over_runs("runs_by_prefix", "SELECT * FROM runs WHERE id ILIKE 'SRC1%'")(lambda r: catalog.runs_by_prefix(r, "SRC1"))
over_runs("running_runs", "SELECT * FROM runs WHERE status = 'running'")(catalog.running_runs)
over_runs("has_active_runs", "SELECT count(*) FILTER (WHERE status = 'running') > 0 AS active FROM runs")(catalog.has_active_runs)
over_files(
    "date_gate",
    """SELECT id, CASE WHEN capture_date < TIMESTAMP '2021-03-01' THEN 'outside date range: before 2021-03-01'
       WHEN capture_date > TIMESTAMP '2022-01-31 23:59:59.999999' THEN 'outside date range: after 2022-01-31' END AS gate_reason FROM files""",
    "id", "gate_reason",
)(lambda f: catalog.date_gate(f, dt.date(2021, 3, 1), dt.date(2022, 1, 31)))
over_both("query_files", f"SELECT {SHORT_SQL} FROM files WHERE status = 'complete' AND capture_date BETWEEN TIMESTAMP '2021-02-01' AND TIMESTAMP '2021-12-31 23:59:59'", *SHORT)(lambda f, r: catalog.query_files(f, r, captured=(dt.date(2021, 2, 1), dt.date(2021, 12, 31))))

# Joins

over_both("files_by_source", f"SELECT {SHORT_SQL} FROM files WHERE run_id IN (SELECT id FROM runs WHERE source = '/cards/1')", *SHORT)(lambda f, r: catalog.files_by_source(f, r, "/cards/1"))
over_both("errors", "SELECT f.id, f.source_path, f.status, f.error, r.source AS run_source FROM files f JOIN runs r ON f.run_id = r.id WHERE f.status IN ('failed', 'mismatch', 'tag_failed')", "id", "source_path", "status", "error", "run_source")(catalog.errors)
over_both("errors_by_run", "SELECT f.id, f.source_path, f.status, f.error, r.source AS run_source FROM files f JOIN runs r ON f.run_id = r.id WHERE f.status IN ('failed', 'mismatch', 'tag_failed') AND f.run_id = 'src2'", "id", "source_path", "status", "error", "run_source")(lambda f, r: catalog.errors(f, r, "src2"))
_PAIRS = """SELECT d.checksum, d.id AS duplicate_id, d.source_path AS duplicate_source, coalesce(d.dest_rel, '') AS duplicate_dest, o.id AS original_id, o.source_path AS original_source,
 coalesce(o.dest_rel, '') AS original_dest FROM files d JOIN files o ON d.checksum = o.checksum WHERE d.is_duplicate AND NOT o.is_duplicate AND o.status = 'complete'"""
over_files("duplicate_pairs", _PAIRS)(catalog.duplicate_pairs)
over_files("duplicate_pairs_by_run", _PAIRS + " AND d.run_id = 'src7'")(lambda f: catalog.duplicate_pairs(f, "src7"))


@query("previously_imported", f"WITH {FILES_SQL}, {CANDIDATES_SQL} SELECT id, source_path, checksum FROM candidates c WHERE EXISTS (SELECT 1 FROM files f WHERE f.source_path = c.source_path AND f.checksum = c.checksum AND f.status IN ('complete', 'duplicate'))")
def _imported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.imported_before(views.candidates(spark, sf_dir).select("id", "source_path", "checksum"), files(spark, sf_dir))


_KNOWN = "known AS (SELECT checksum, coalesce(nullif((array_agg(dest_rel ORDER BY dest_rel IS NULL, id))[1], ''), '<duplicate>') AS existing FROM files WHERE status = 'complete' AND checksum IS NOT NULL GROUP BY checksum)"


@query("duplicate_lookup", f"WITH {FILES_SQL}, {CANDIDATES_SQL}, {_KNOWN} SELECT c.id, c.checksum, k.existing FROM candidates c LEFT JOIN known k ON c.checksum = k.checksum")
def _lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.known_copies(views.candidates(spark, sf_dir).select("id", "checksum"), files(spark, sf_dir)).select("id", "checksum", "existing")


@query("duplicate_lookup_indexed", f"WITH {FILES_SQL}, {CANDIDATES_SQL}, {_KNOWN} SELECT c.id, c.checksum, k.existing FROM candidates c LEFT JOIN known k ON c.checksum = k.checksum")
def _indexed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = "checksums_" + uuid.uuid4().hex
    index.write(files(spark, sf_dir), name, shared_folder(spark, "index"), 16)
    return index.lookup(spark, views.candidates(spark, sf_dir).select("id", "checksum"), name, 16).select("id", "checksum", "existing")


over_files("first_writer_dedup", "SELECT f.id, coalesce(m.first_id, f.id) AS first_id, coalesce(m.first_id, f.id) = f.id AS is_first FROM files f LEFT JOIN (SELECT checksum, min(id) AS first_id FROM files WHERE checksum IS NOT NULL GROUP BY checksum) m ON f.checksum = m.checksum", "id", "first_id", "is_first")(catalog.first_writers)
over_both("algorithm_backfill", "SELECT f.id, coalesce(f.algorithm, r.algorithm) AS algorithm FROM files f LEFT JOIN runs r ON f.run_id = r.id", "id", "algorithm")(catalog.backfilled_algorithm)


@query("retry_candidates", f"WITH {FILES_SQL}, {CANDIDATES_SQL} SELECT f.id, f.source_path FROM files f WHERE f.status IN ('failed', 'mismatch', 'tag_failed') AND f.source_path IN (SELECT source_path FROM candidates) AND lower(f.ext) IN ('.jpg', '.jpeg', '.png', '.heic')")
def _retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = files(spark, sf_dir).where(F.col("status").isin("failed", "mismatch", "tag_failed"))
    known = list(formats.Registry().by_extension())
    return catalog.retryable(bad, views.candidates(spark, sf_dir).select(F.col("source_path").alias("path")), F.lower("ext").isin(*known)).select("id", "source_path")


def _sidecar_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = table(spark, sf_dir, "documents").select("doc_id", "source", views.ext(F.col("lang")).alias("ext"))
    folder, name = F.concat(F.lit("/in/"), "source"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    media = d.select(folder.alias("dir"), F.concat(name, F.col("ext")).alias("name"), F.concat_ws("/", folder, F.concat(name, F.col("ext"))).alias("path"), F.col("doc_id").alias("seq"))
    side = F.when(F.col("doc_id") % 3 == 0, F.concat(name, F.lit(".xmp"))).when(F.col("doc_id") % 3 == 1, F.concat(F.upper(name), F.col("ext"), F.lit(".aae"))).otherwise(F.concat(F.lit("other_"), name, F.lit(".xmp")))
    return media, d.select(folder.alias("dir"), side.alias("name"), F.concat_ws("/", folder, side).alias("path"))


_SIDECARS_SQL = """WITH d AS (SELECT doc_id, '/in/' || source AS dir, 'doc_' || doc_id AS stem, CASE lang WHEN 'en' THEN '.jpg' WHEN 'fr' THEN '.JPEG' WHEN 'de' THEN '.png' ELSE '.heic' END AS ext FROM documents),
 media AS (SELECT doc_id AS seq, dir, stem || ext AS name, stem, dir || '/' || stem || ext AS path FROM d),
 side AS (SELECT dir, CASE doc_id % 3 WHEN 0 THEN stem || '.xmp' WHEN 1 THEN upper(stem) || ext || '.aae' ELSE 'other_' || stem || '.xmp' END AS name FROM d) """


@query("sidecar_assoc_sort", _SIDECARS_SQL + "SELECT s.dir || '/' || s.name AS path, coalesce(f.path, t.path) AS media_path FROM side s LEFT JOIN media f ON f.dir = s.dir AND lower(f.name) = lower(s.name[:-5]) LEFT JOIN media t ON t.dir = s.dir AND lower(t.stem) = lower(s.name[:-5])")
def _sidecars_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sidecars.attached_on_ingest(*_sidecar_inputs(spark, sf_dir)).select("path", "media_path")


@query("sidecar_assoc_verify", _SIDECARS_SQL + "SELECT s.dir || '/' || s.name AS path, f.path AS media_path FROM side s LEFT JOIN media f ON f.dir = s.dir AND f.name = s.name[:-5]")
def _sidecars_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sidecars.attached_in_archive(*_sidecar_inputs(spark, sf_dir)).select("path", "media_path")


@query("sidecar_extensions", _SIDECARS_SQL + "SELECT m.path AS media_path, ' [' || string_agg(DISTINCT '+' || s.name[-3:], ' ' ORDER BY '+' || s.name[-3:] DESC) || ']' AS note FROM side s JOIN media m ON m.dir = s.dir AND (lower(m.name) = lower(s.name[:-5]) OR lower(m.stem) = lower(s.name[:-5])) GROUP BY m.path")
def _sidecar_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sidecars.extensions_by_media(sidecars.attached_on_ingest(*_sidecar_inputs(spark, sf_dir)))
    return found.select("media_path", text.sidecar_note(F.col("extensions")).alias("note"))


_TREE_SQL = f"WITH {FILES_SQL}, tree AS (SELECT '/a/' || strftime(capture_date, '%Y%m%d_%H%M%S') || '_' || checksum || ext AS path FROM files WHERE checksum IS NOT NULL UNION ALL SELECT '/a/' || strftime(capture_date, '%Y%m%d_%H%M%S') || '_' || checksum || CASE WHEN id % 4 = 0 THEN '.gone' ELSE ext END || '.xmp' FROM files WHERE checksum IS NOT NULL)"


@query("orphan_sidecars", _TREE_SQL + " SELECT path FROM tree t WHERE regexp_matches(path, '^/a/[0-9]{8}_[0-9]{6}_[0-9a-f]+\\..+\\.xmp$') AND NOT EXISTS (SELECT 1 FROM tree m WHERE m.path = t.path[:-5])")
def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir).where("checksum is not null")
    stem = F.concat(paths.run_stamp(F.col("capture_date")), F.lit("_"), "checksum")
    names = f.select(F.concat(stem, F.col("ext")).alias("name")).unionByName(f.select(F.concat(stem, F.when(F.col("id") % 4 == 0, ".gone").otherwise(F.col("ext")), F.lit(".xmp")).alias("name")))
    return sidecars.orphaned_in_archive(names.select(F.concat(F.lit("/a/"), "name").alias("path"), "name"))


# Aggregates


@query("list_runs", "SELECT o.o_orderkey AS id, o.o_orderpriority AS source, o.o_orderdate AS started_at, CASE o.o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'interrupted' END AS status, count(l.l_orderkey) AS file_count FROM orders o LEFT JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY ALL")
def _list_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.list_runs(*views.order_runs(spark, sf_dir))


@query("runs_summary", "SELECT (SELECT count(*) FROM orders) AS runs, CAST((SELECT count(*) FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey) AS BIGINT) AS files")
def _runs_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.runs_summary(*views.order_runs(spark, sf_dir))


_C = "count(*) FILTER (WHERE {}) AS {}".format
over_both("archive_stats", "SELECT count(*) AS total, " + ", ".join([_C("status = 'complete'", "complete"), _C("is_duplicate", "duplicates"), _C("status = 'failed'", "failed"), _C("status = 'mismatch'", "mismatches"), _C("status = 'tag_failed'", "tag_failed"), _C("status = 'skipped'", "skipped")]) + ", CAST(coalesce(sum(file_size), 0) AS BIGINT) AS total_size, min(capture_date) AS earliest, max(capture_date) AS latest, (SELECT count(*) FROM runs) AS runs FROM files")(catalog.archive_stats)
_FORMATS = "SELECT lower(substr(dest_rel, instr(dest_rel, '.'))) AS extension, count(*) AS files FROM files WHERE status = 'complete' AND NOT is_duplicate AND contains(dest_rel, '.') GROUP BY 1"
over_files("format_breakdown", _FORMATS)(catalog.format_breakdown)
over_files("format_share", f"SELECT extension, files, CAST(100 AS DOUBLE) * files / sum(files) OVER () AS percent FROM ({_FORMATS})")(catalog.format_shares)
over_runs("last_run_date", "SELECT max(finished_at) AS last_run FROM runs WHERE status = 'completed'")(catalog.last_run_date)
over_files("error_summary", "SELECT count(*) AS total, " + ", ".join(_C(f"status = '{s}'", s) for s in ("failed", "mismatch", "tag_failed")) + " FROM files WHERE status IN ('failed', 'mismatch', 'tag_failed')")(catalog.error_summary)
over_files("skip_summary", "SELECT count(*) AS total, " + _C("skip_reason LIKE 'unsupported%'", "unsupported") + ", " + _C("skip_reason LIKE 'previously%'", "previously_imported") + " FROM files WHERE status = 'skipped'")(catalog.skip_summary)
over_files("run_summary", "SELECT run_id, count(*) AS total, " + ", ".join([_C("status = 'complete' AND NOT is_duplicate", "complete"), _C("status = 'complete' AND is_duplicate", "duplicates"), _C("status = 'skipped'", "skipped"), _C("status IN ('failed', 'mismatch', 'tag_failed')", "errors")]) + " FROM files GROUP BY run_id")(catalog.run_summary)
over_files("inventory_summary", "SELECT count(*) AS files, min(capture_date) AS earliest, max(capture_date) AS latest FROM files WHERE status = 'complete' AND NOT is_duplicate")(lambda f: catalog.date_summary(catalog.inventory(f)))
over_runs("latest_run", "SELECT * FROM runs WHERE status IN ('completed', 'interrupted') ORDER BY started_at DESC, id LIMIT 1")(catalog.latest_run)
over_runs("latest_run_by_source", "SELECT * FROM runs WHERE status IN ('completed', 'interrupted') AND source = '/cards/2' ORDER BY started_at DESC, id LIMIT 1")(lambda r: catalog.latest_run(r, "/cards/2"))
over_runs("latest_interrupted", "SELECT * FROM runs WHERE status = 'running' ORDER BY started_at DESC, id LIMIT 1")(catalog.latest_interrupted)

# Ledgers


@query("ledger_fold", f"WITH {LEDGER_SQL} SELECT path, seq, status FROM folded")
def _fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.folded(views.ledger(spark, sf_dir)).select("path", "seq", "status")


@query("ledger_run_assignment", "SELECT 'user_' || user_id AS ledger, event_id AS seq, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS run_seq FROM events")
def _assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(F.concat(F.lit("user_"), "user_id").alias("ledger"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", 4).alias("version"))
    return ledger.with_runs(lines).select("ledger", "seq", "run_seq")


@query("ledger_run_assignment_single", "SELECT event_id AS seq, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (ORDER BY event_id) AS BIGINT) AS run_seq FROM events")
def _assigned_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one ledger, cut into parts of 1,024 lines."""
    lines = table(spark, sf_dir, "events").select(F.lit("all").alias("ledger"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", 4).alias("version"))
    return ledger.with_runs(lines, part=1 << 10).select("seq", "run_seq")


@query("ledger_latest_entries", "WITH l AS (SELECT user_id, event_id, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), m AS (SELECT user_id, max(r) AS r FROM l GROUP BY user_id) SELECT 'user_' || l.user_id AS ledger, l.event_id AS seq FROM l JOIN m ON l.user_id = m.user_id AND l.r = m.r WHERE l.event_type <> 'signup'")
def _latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(F.concat(F.lit("user_"), "user_id").alias("ledger"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", 4).alias("version"))
    return ledger.latest_entries(ledger.with_runs(lines)).select("ledger", "seq")


_STATUS_SQL = f"""WITH {LEDGER_SQL}, status AS (
 SELECT CASE f.status WHEN 'copy' THEN 'SORTED' WHEN 'duplicate' THEN 'DUPLICATE' WHEN 'error' THEN 'ERRORED' ELSE 'UNSORTED' END AS bucket, c.path,
        CASE f.status WHEN 'copy' THEN f.destination WHEN 'duplicate' THEN f.matches WHEN 'error' THEN f.reason END AS detail
 FROM (SELECT 'user_' || c_custkey AS path FROM customer) c LEFT JOIN folded f ON c.path = f.path
 UNION ALL SELECT 'UNRECOGNIZED', 'file_' || s_suppkey || '.txt', 'unsupported format: .txt' FROM supplier)"""


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    there = table(spark, sf_dir, "customer").select(F.concat(F.lit("user_"), "c_custkey").alias("path"))
    skipped = table(spark, sf_dir, "supplier").select(F.concat(F.lit("file_"), "s_suppkey", F.lit(".txt")).alias("path"), F.lit("unsupported format: .txt").alias("reason"))
    return ledger.source_status(there, skipped, ledger.folded(views.ledger(spark, sf_dir)))


query("source_status", _STATUS_SQL + " SELECT * FROM status")(_status)
query("status_summary", _STATUS_SQL + " SELECT count(*) AS total, " + ", ".join(_C(f"bucket = '{b}'", b.lower()) for b in ("SORTED", "DUPLICATE", "ERRORED", "UNSORTED", "UNRECOGNIZED")) + " FROM status")(lambda s, d: ledger.status_summary(_status(s, d)))
query("ledger_copied", f"WITH {LEDGER_SQL} SELECT count(*) AS copied FROM entries WHERE status = 'copy'")(lambda s, d: ledger.successes(views.ledger(s, d)))

# Diagnosis

_ENTRIES_SQL = f"""{FILES_SQL}, {RUNS_SQL}, problems AS (
 SELECT f.source_path AS path, f.status, f.error AS message FROM files f JOIN runs r ON f.run_id = r.id WHERE f.status IN ('failed', 'mismatch', 'tag_failed')
 UNION ALL SELECT source_path, 'skip', skip_reason FROM files WHERE status = 'skipped'
 UNION ALL SELECT source_path, 'duplicate', NULL FROM files WHERE is_duplicate)"""
_RULED_SQL = """ruled AS (SELECT path, CASE
 WHEN status IN ('error', 'failed') AND message ILIKE '%extract date:%' THEN 1 WHEN status IN ('error', 'failed') AND (message ILIKE '%open hashable reader:%' OR message ILIKE '%hash payload:%') THEN 2
 WHEN status IN ('error', 'failed') AND (message ILIKE '%permission denied%' OR message ILIKE '%input/output error%' OR message ILIKE '%no such file%' OR message ILIKE '%no space left%' OR message ILIKE '%read %' OR message ILIKE '%write %') THEN 3
 WHEN status IN ('error', 'failed') AND message ILIKE '%copy:%' THEN 4 WHEN status IN ('mismatch', 'error') AND message ILIKE '%verify:%' THEN 5 WHEN status IN ('tag_failed', 'error') AND message ILIKE '%tag %' THEN 6
 WHEN status IN ('error', 'failed') AND (message ILIKE '%dedup check:%' OR message ILIKE '%promote:%' OR message ILIKE '%relocate%') THEN 7
 WHEN status = 'skip' AND message ILIKE '%unsupported format:%' THEN 8 WHEN status = 'skip' AND message ILIKE '%previously imported%' THEN 9 WHEN status = 'skip' AND message ILIKE '%outside date range:%' THEN 10
 WHEN status = 'skip' AND message ILIKE '%symlink%' THEN 11 WHEN status = 'skip' AND message ILIKE '%dotfile%' THEN 12 WHEN status = 'skip' AND message ILIKE '%detection error:%' THEN 13
 WHEN status IN ('error', 'failed', 'mismatch', 'tag_failed') THEN 14 END AS rule_order FROM problems WHERE status <> 'duplicate')"""


def _problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, r = files(spark, sf_dir), runs(spark, sf_dir)
    return doctor.problem_entries(catalog.errors(f, r), catalog.skipped(f), catalog.duplicates(f))


query("doctor_entries", f"WITH {_ENTRIES_SQL} SELECT * FROM problems")(_problems)
_NAMES_SQL = """names(rule_order, category, section, severity) AS (VALUES (1, 'Corrupted metadata', 'errors', 'actionable'), (2, 'Corrupt file structure', 'errors', 'actionable'),
 (3, 'Disk or permission error', 'errors', 'actionable'), (4, 'Copy failure', 'errors', 'actionable'), (5, 'Integrity mismatch', 'errors', 'actionable'), (6, 'Tag injection failed', 'errors', 'actionable'),
 (7, 'Database error', 'errors', 'actionable'), (8, 'Unsupported format', 'skipped', 'informational'), (9, 'Previously imported', 'skipped', 'informational'), (10, 'Outside date range', 'skipped', 'informational'),
 (11, 'Symbolic link', 'skipped', 'informational'), (12, 'Hidden file', 'skipped', 'informational'), (13, 'Detection error', 'skipped', 'actionable'), (14, 'Unexpected error', 'errors', 'actionable'))"""
query("doctor_report", f"WITH {_ENTRIES_SQL}, {_RULED_SQL}, {_NAMES_SQL} SELECT CAST(r.rule_order AS INT) AS rule_order, n.section, n.category, n.severity, r.path FROM ruled r JOIN names n ON r.rule_order = n.rule_order")(lambda s, d: doctor.report(_problems(s, d)))
query("doctor_counts", f"WITH {_ENTRIES_SQL}, {_RULED_SQL}, {_NAMES_SQL} SELECT CAST(r.rule_order AS INT) AS rule_order, n.section, n.category, n.severity, count(*) AS files FROM ruled r JOIN names n ON r.rule_order = n.rule_order GROUP BY ALL")(lambda s, d: doctor.report_counts(_problems(s, d)))
query("doctor_duplicates", f"WITH {_ENTRIES_SQL} SELECT count(*) FILTER (WHERE status = 'duplicate') AS duplicates FROM problems")(lambda s, d: doctor.duplicate_count(_problems(s, d)))

# Scalar functions over whole columns


@query("content_hash", "SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256 FROM documents")
def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", *(hashing.content_hash(content, a).alias(a) for a in ("md5", "sha1", "sha256")))


@query("content_hash_xxh64")
def _xxh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", hashing.content_hash(F.col("text").cast("binary"), "xxhash").alias("xxhash"))


query("file_ext", "SELECT page_id, regexp_extract(url, '(\\.[^./\\\\]*)$', 1) AS ext FROM pages")(lambda s, d: table(s, d, "pages").select("page_id", paths.extension(F.col("url")).alias("ext")))


@query("dest_path", f"WITH {FILES_SQL} SELECT id, (CASE WHEN is_duplicate THEN 'duplicates/20260306_103000/' ELSE '' END) || strftime(capture_date, '%Y/%m-%b/%Y%m%d_%H%M%S') || '-2-' || checksum || lower(ext) AS path, strftime(capture_date, '%Y/%d/%H%M%S') || lower(substr(ext, 2)) AS custom FROM files")
def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.col("capture_date")
    return files(spark, sf_dir).select("id", paths.destination(date, "sha256", F.col("checksum"), F.col("ext"), F.col("is_duplicate"), F.lit(views.STAMP)).alias("path"), paths.parse_template("{year}/{day}/{hour}{minute}{second}{ext}").column(date, F.col("ext")).alias("custom"))


_NAME_SQL = f"WITH {FILES_SQL}, named AS (SELECT id, CASE id % 4 WHEN 0 THEN strftime(capture_date, '%Y%m%d_%H%M%S') || '-1-' || checksum || ext WHEN 1 THEN strftime(capture_date, '%Y%m%d_%H%M%S') || '_' || checksum || ext WHEN 2 THEN 'IMG_' || id || '.jpg' ELSE strftime(capture_date, '%Y%m%d_%H%M%S') || '-9-' || checksum || ext END AS name, checksum FROM files)"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp, tail, k = paths.run_stamp(F.col("capture_date")), F.concat("checksum", "ext"), F.col("id") % 4
    name = F.when(k == 0, F.concat(stamp, F.lit("-1-"), tail)).when(k == 1, F.concat(stamp, F.lit("_"), tail)).when(k == 2, F.concat(F.lit("IMG_"), F.col("id").cast("string"), F.lit(".jpg"))).otherwise(F.concat(stamp, F.lit("-9-"), tail))
    return files(spark, sf_dir).select("id", name.alias("name"))


query("parse_checksum", _NAME_SQL + " SELECT id, name, CASE WHEN name IS NOT NULL AND id % 4 IN (0, 1) THEN checksum ELSE '' END AS checksum, CASE WHEN name IS NOT NULL AND id % 4 IN (0, 1) THEN 'sha1' ELSE '' END AS algorithm, name IS NOT NULL AND id % 4 IN (0, 1) AS ok FROM named")(lambda s, d: _names(s, d).withColumn("p", paths.parsed_name(F.col("name"))).select("id", "name", "p.checksum", "p.algorithm", "p.ok"))


@query("display_formats", f"WITH {FILES_SQL} SELECT id, CASE WHEN coalesce(checksum, '') = '' THEN '—' ELSE left(checksum, 8) || '…' END AS short_checksum, format('{{:,}}', file_size) AS commas, CASE WHEN file_size * 1000 >= 1000000000 THEN printf('%.1f GB', file_size / 1e6) WHEN file_size * 1000 >= 1000000 THEN printf('%.1f MB', file_size / 1e3) WHEN file_size * 1000 >= 1000 THEN printf('%.1f KB', file_size / 1e0) ELSE printf('%d B', file_size * 1000) END AS size, strftime(capture_date, '%Y-%m-%dT%H:%M:%SZ') AS rfc3339 FROM files")
def _display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).select("id", text.short_checksum(F.col("checksum")).alias("short_checksum"), text.with_commas(F.col("file_size")).alias("commas"), text.decimal_size(F.col("file_size") * 1000).alias("size"), text.rfc3339(F.col("capture_date")).alias("rfc3339"))


query("run_duration", f"WITH {RUNS_SQL}, t AS (SELECT id, CAST(epoch(finished_at) - epoch(started_at) AS BIGINT) AS s FROM runs) SELECT id, CAST(s AS DOUBLE) AS seconds, CASE WHEN s IS NULL THEN '—' WHEN s < 1 THEN '0.0s' WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ' || (s % 60) || 's' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS elapsed FROM t")(
    lambda s, d: runs(s, d).select("id", text.seconds_between(F.col("started_at"), F.col("finished_at")).alias("seconds"), text.duration(F.col("started_at"), F.col("finished_at")).alias("elapsed"))
)
query("exif_dates", f"WITH {FILES_SQL} SELECT id, CASE id % 3 WHEN 0 THEN capture_date WHEN 1 THEN capture_date + INTERVAL 1 DAY ELSE TIMESTAMP '1902-02-20' END AS captured, CASE WHEN id = 0 THEN TIMESTAMP '1902-02-20' ELSE TIMESTAMP '1904-01-01' + to_seconds(id * 86413) END AS container FROM files")(
    lambda s, d: files(s, d).select(
        "id",
        dates.capture_date(F.when(F.col("id") % 3 == 0, F.date_format("capture_date", " yyyy:MM:dd HH:mm:ss ")).otherwise(F.lit("broken")), F.when(F.col("id") % 3 == 1, F.date_format(F.timestamp_add("DAY", F.lit(1), F.col("capture_date")), "yyyy:MM:dd HH:mm:ss"))).alias("captured"),
        dates.container_date(F.col("id") * 86413).alias("container"),
    )
)
query("ignore_match", f"WITH {FILES_SQL} SELECT id, regexp_matches(source_path, '/doc_1[0-9]\\.jpg$') OR regexp_matches(source_path, '/[^/]*\\.png$') OR regexp_matches(source_path, '/doc_2[^/]*$') OR regexp_matches(source_path, '^/source/[^/]*7\\.heic$') AS ignored FROM files")(
    lambda s, d: files(s, d).select("id", globs.ignored_file(F.regexp_extract("source_path", "([^/]*)$", 1), F.substring("source_path", 2, 1 << 30), ["doc_1?.jpg", "*.png", "**/doc_2*", "source/*7.heic", "source/"]).alias("ignored"))
)


@query(
    "ignore_scopes",
    """WITH t AS (SELECT doc_id, source || '/doc_' || doc_id || '.' || lang AS rel, 'doc_' || doc_id || '.' || lang AS name, source FROM documents)
 SELECT doc_id, coalesce(regexp_matches(name, '7\\.[a-z]*$') OR regexp_matches(rel, '^src5/doc_[0-9]*\\.en$') OR regexp_matches(rel, '^src1[^/]/') OR (source = 'src3' AND (regexp_matches(name, '\\.de$') OR name LIKE 'doc_1%'))
   OR (source = 'src4' AND regexp_matches(name, '^doc_2[^/]*$')), false) AS hidden,
   coalesce(source = 'src6' OR (source LIKE 'src1_'), false) AS folder_hidden FROM t""",
)
def _scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc_"), F.col("doc_id"), F.lit("."), F.col("lang"))
    rel = F.concat_ws("/", "source", "name")
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", name.alias("name")).withColumn("rel", F.when(F.col("source").isNotNull(), rel))
    scopes = {"": ["*7.*", "src5/doc_*.en", "src6/", "src1?/**"], "src3": ["*.de", "doc_1*", "other/"], "src4": ["doc_2*"]}
    return rows.select("doc_id", F.coalesce(globs.hidden_file(F.col("name"), F.col("rel"), scopes), F.lit(False)).alias("hidden"), F.coalesce(globs.hidden_folder(F.col("source"), F.col("source"), scopes), F.lit(False)).alias("folder_hidden"))


_LANGS = ("en", "de", "fr", "es")


@query(
    "ignore_scopes_joined",
    """WITH t AS (SELECT doc_id, source || '/' || lang || '/doc_' || doc_id || '.' || lang AS rel, 'doc_' || doc_id || '.' || lang AS name FROM documents),
 s AS (SELECT k, CASE WHEN k < 9000 THEN 'src' || k ELSE 'src' || (k % 40) || '/' || ['en', 'de', 'fr', 'es'][1 + k % 4] END AS scope,
   CASE WHEN k < 9000 THEN '7\\.' || ['en', 'de', 'fr', 'es'][1 + k % 4] || '$' ELSE '^doc_[^/]*' || (k % 100) || '[^/]\\.[^/]*$' END AS regex FROM range(10000) r(k)),
 found AS (SELECT DISTINCT t.doc_id FROM t JOIN s ON starts_with(t.rel, s.scope || '/') AND regexp_matches(t.name, s.regex))
 SELECT doc_id, doc_id IN (SELECT doc_id FROM found) AS hidden FROM t""",
)
def _scopes_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of 10,000 scopes with a pattern each."""
    k, lang = F.col("id"), views._pick(F.col("id"), *_LANGS)
    scope = F.when(k < 9000, F.concat(F.lit("src"), k)).otherwise(F.concat(F.lit("src"), k % 40, F.lit("/"), lang))
    pattern = F.when(k < 9000, F.concat(F.lit("*7."), lang)).otherwise(F.concat(F.lit("doc_*"), k % 100, F.lit("?.*")))
    name = F.concat(F.lit("doc_"), F.col("doc_id"), F.lit("."), F.col("lang"))
    rows = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"), F.concat("source", F.lit("/"), "lang", F.lit("/"), name).alias("rel"))
    return rules.hidden(rows, spark.range(10000).select(scope.alias("scope"), pattern.alias("pattern"))).select("doc_id", "hidden")


@query(
    "doctor_rules_joined",
    f"""WITH {FILES_SQL}, m AS (SELECT id, status, coalesce(error, skip_reason) || ' at ' || source_path AS message FROM files WHERE status IN ('failed', 'mismatch', 'tag_failed', 'skipped')),
 r(rule_order, status, pattern) AS (SELECT k, 'failed', 'doc_' || k || '.' FROM range(10000) t(k) UNION ALL VALUES (300, 'failed', 'promote:'), (400, 'failed', 'dedup check:'), (20000, 'failed', 'at'), (20001, 'mismatch', 'checksum'), (20002, 'tag_failed', ''), (20003, 'skipped', 'unsupported format:')),
 found AS (SELECT m.id, min(r.rule_order) AS rule_order FROM m JOIN r ON m.status = r.status AND contains(lower(m.message), r.pattern) GROUP BY m.id)
 SELECT m.id, coalesce(f.rule_order, -1) AS rule_order FROM m LEFT JOIN found f ON m.id = f.id""",
)
def _rules_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of 10,000 rules and some more."""
    bad = files(spark, sf_dir).where(F.col("status").isin("failed", "mismatch", "tag_failed", "skipped"))
    rows = bad.select("id", "status", F.concat(F.coalesce("error", "skip_reason"), F.lit(" at "), "source_path").alias("message"))
    few = [(300, "failed", "Promote:"), (400, "failed", "dedup check:"), (20000, "failed", "at"), (20001, "mismatch", "checksum"), (20002, "tag_failed", ""), (20003, "skipped", "unsupported format:")]
    many = spark.range(10000).select(F.col("id").alias("rule_order"), F.lit("failed").alias("status"), F.concat(F.lit("doc_"), "id", F.lit(".")).alias("pattern"))
    return rules.first_rules(rows, many.unionByName(spark.createDataFrame(few, many.schema))).select("id", F.coalesce("rule_order", F.lit(-1).cast("bigint")).alias("rule_order"))


@query(
    "path_display",
    f"""WITH {FILES_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN dest_rel ELSE 'A/' || dest_rel END AS shown,
 CASE WHEN contains(dest_rel, '/') THEN regexp_extract(dest_rel, '^(.*/)', 1) ELSE '' END || '.' || regexp_extract(dest_rel, '([^/]*)$', 1) || '.part' AS temporary,
 id % 3 = 0 AS is_temporary, string_split(source_path, '/')[2] || '-' || left(sha256(source_path), 8) AS folder_slug FROM files WHERE dest_rel IS NOT NULL""",
)
def _path_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, marker = files(spark, sf_dir).where("dest_rel is not null"), ".part"
    temporary = paths.temporary_path(F.col("dest_rel"), marker)
    slug = F.regexp_replace(hashing.slug(F.concat(F.lit("/x/"), F.element_at(F.split("source_path", "/"), 2))), "-[0-9a-f]{8}$", "")
    return rows.select(
        "id", paths.display_destination(F.when(F.col("id") % 2 == 0, "").otherwise("A"), F.col("dest_rel")).alias("shown"), temporary.alias("temporary"),
        paths.is_temporary(F.when(F.col("id") % 3 == 0, temporary).otherwise(F.col("dest_rel")), marker).alias("is_temporary"),
        F.concat(slug, F.substring(hashing.slug(F.col("source_path")), -9, 9)).alias("folder_slug"),
    )


@query(
    "text_display",
    f"""WITH {FILES_SQL} SELECT id, left(checksum, 8) || '…' AS short_id, CASE WHEN file_size >= 1048576 THEN printf('%.1f MB', file_size / 1048576) WHEN file_size >= 1024 THEN printf('%.1f KB', file_size / 1024) ELSE printf('%d B', file_size) END AS size,
 strftime(capture_date, '%Y-%m-%d %H:%M:%S') AS at, CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN '1 file' ELSE '2 files' END AS counted, 'COPY ' || source_path || ' -> ' || run_id AS line FROM files WHERE run_id IS NOT NULL""",
)
def _text_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).where("run_id is not null").select(
        "id", text.short_id(F.col("checksum")).alias("short_id"), text.binary_size(F.col("file_size")).alias("size"), text.day_and_time(F.col("capture_date")).alias("at"),
        text.counted(F.col("id") % 3, "file").alias("counted"), text.outcome_line(F.lit("COPY"), F.col("source_path"), F.col("run_id")).alias("line"),
    )


_HEADERS = ("FFD8FF00", "00000018667479706865", "89504E470D0A1A0A", "49492A0008000000", "4D4D002A00000008", "00000000", "")


@query("detect_format", f"WITH {FILES_SQL}, h AS (SELECT id, lower(ext) AS ext, id % 7 AS k FROM files) SELECT id, CASE WHEN k = 0 THEN 'JPEG' WHEN k = 1 THEN 'HEIC' WHEN k = 2 THEN 'PNG' WHEN k IN (3, 4) THEN 'DNG' END AS format FROM h")
def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    header = F.unhex(views._pick(F.col("id"), *_HEADERS))
    return files(spark, sf_dir).select("id", formats.Registry().detect(F.col("ext"), header).alias("format"))


_PACKET_SQL = f"""WITH {FILES_SQL}, o AS (SELECT id, strftime(capture_date, '%Y') AS y, CASE WHEN id % 2 = 0 THEN run_id END AS owner FROM files)
 SELECT id, md5('<?xpacket begin="' || chr(65279) || '" id="W5M0MpCehiHzreSzNTczkc9d"?>
<x:xmpmeta xmlns:x="adobe:ns:meta/">
  <rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#">
    <rdf:Description rdf:about=""
      xmlns:dc="http://purl.org/dc/elements/1.1/"
      xmlns:xmpRights="http://ns.adobe.com/xap/1.0/rights/"' || CASE WHEN coalesce(owner, '') <> '' THEN '
      xmlns:aux="http://ns.adobe.com/exif/1.0/aux/"' ELSE '' END || '>
      <dc:rights>
        <rdf:Alt>
          <rdf:li xml:lang="x-default">(c) ' || y || ' &amp; heirs</rdf:li>
        </rdf:Alt>
      </dc:rights>
      <xmpRights:Marked>True</xmpRights:Marked>' || CASE WHEN coalesce(owner, '') <> '' THEN '
      <aux:OwnerName>' || owner || '</aux:OwnerName>' ELSE '' END || '
    </rdf:Description>
  </rdf:RDF>
</x:xmpmeta>
<?xpacket end="w"?>
') AS packet_md5 FROM o"""


@query("xmp_packet", _PACKET_SQL)
def _packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rights = paths.parse_copyright("(c) {year} & heirs").column(F.col("capture_date"))
    return files(spark, sf_dir).select("id", F.md5(xmp.packet(rights, F.when(F.col("id") % 2 == 0, F.col("run_id")))).alias("packet_md5"))


query("xml_escape", "SELECT conv_id, turn, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') AS escaped FROM conversations")(lambda s, d: table(s, d, "conversations").select("conv_id", "turn", text.xml_escape(F.col("text")).alias("escaped")))

# Whole commands

_PLAN_PARTS = f"""{FILES_SQL}, {CANDIDATES_SQL}, {_KNOWN},
 state AS (SELECT c.*, CASE WHEN c.capture_date < TIMESTAMP '2021-02-01' THEN 'outside date range: before 2021-02-01' END AS gate,
   EXISTS (SELECT 1 FROM files f WHERE f.source_path = c.source_path AND f.checksum = c.checksum AND f.status IN ('complete', 'duplicate')) AS imported, k.existing
   FROM candidates c LEFT JOIN known k ON c.checksum = k.checksum),
 firsts AS (SELECT checksum, min(id) AS first_id FROM state WHERE error IS NULL AND gate IS NULL AND NOT imported GROUP BY checksum),
 placed AS (SELECT s.*, s.error IS NULL AND s.gate IS NULL AND NOT s.imported AS competes, f.first_id, strftime(s.capture_date, '%Y/%m-%b/%Y%m%d_%H%M%S') || '-1-' || s.checksum || lower(s.ext) AS place
   FROM state s LEFT JOIN firsts f ON s.checksum = f.checksum),
 plan AS (SELECT p.*, p.competes AND coalesce(p.existing IS NOT NULL OR p.id <> p.first_id, false) AS dup FROM placed p)"""
_PLAN_SQL = f"""WITH {_PLAN_PARTS}
 SELECT p.id, CASE WHEN p.error IS NOT NULL THEN 'error' WHEN p.gate IS NOT NULL OR p.imported THEN 'skip' WHEN p.dup THEN 'duplicate' ELSE 'copy' END AS outcome,
   CASE WHEN p.error IS NOT NULL THEN p.error WHEN p.gate IS NOT NULL THEN p.gate WHEN p.imported THEN 'previously imported' END AS reason,
   p.dup AS is_duplicate, CASE WHEN p.dup THEN coalesce(p.existing, o.place) END AS matches,
   CASE WHEN p.competes THEN (CASE WHEN p.dup THEN 'duplicates/20260306_103000/' ELSE '' END) || p.place END AS dest_rel
 FROM plan p LEFT JOIN placed o ON o.id = p.first_id"""


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.planned(views.candidates(spark, sf_dir), files(spark, sf_dir), views.STAMP, since=dt.date(2021, 2, 1))


def _sort_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned(spark, sf_dir).select("id", "outcome", "reason", "is_duplicate", "matches", "dest_rel")


query("sort_plan", _PLAN_SQL)(_sort_plan)
query("sort_counters", f"SELECT count(*) FILTER (WHERE outcome IN ('copy', 'duplicate')) AS processed, count(*) FILTER (WHERE outcome = 'duplicate') AS duplicates, count(*) FILTER (WHERE outcome = 'skip') AS skipped, count(*) FILTER (WHERE outcome = 'error') AS errors FROM ({_PLAN_SQL})")(lambda s, d: ingest.counters(_sort_plan(s, d)))


@query("copy_takeover", f"""WITH RECURSIVE {_PLAN_PARTS},
 competing AS (SELECT id, checksum, place, row_number() OVER (PARTITION BY checksum ORDER BY id) AS n FROM plan WHERE competes AND existing IS NULL AND checksum IS NOT NULL),
 tried AS (SELECT checksum, n, id, place, id % 5 < 3 AS failed FROM competing WHERE n = 1
   UNION ALL SELECT c.checksum, c.n, c.id, c.place, c.id % 5 < 3 FROM tried t JOIN competing c ON c.checksum = t.checksum AND c.n = t.n + 1 WHERE t.failed),
 stayed AS (SELECT checksum, place FROM tried WHERE NOT failed),
 ended AS (SELECT p.*, p.dup AND t.id IS NULL AS still_dup, s.place AS stayed FROM plan p LEFT JOIN tried t ON p.id = t.id LEFT JOIN stayed s ON p.checksum = s.checksum)
 SELECT id, CASE WHEN error IS NOT NULL THEN 'error' WHEN gate IS NOT NULL OR imported THEN 'skip' WHEN still_dup THEN 'duplicate' ELSE 'copy' END AS outcome, still_dup AS is_duplicate,
   CASE WHEN still_dup THEN coalesce(existing, stayed) END AS matches, CASE WHEN competes THEN (CASE WHEN still_dup THEN 'duplicates/20260306_103000/' ELSE '' END) || place END AS dest_rel,
   CASE WHEN competes AND place IS NOT NULL THEN CASE WHEN id % 5 < 3 THEN 'failed' ELSE 'complete' END END AS copied
 FROM ended""")
def _takeover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three of five copies fail, so that firsts fail several times in a row."""
    table_ = tables(spark, "takeover")
    attempt = lambda rows: rows.where("dest_rel is not null").select("id", F.when(F.col("id") % 5 < 3, "failed").otherwise("complete").alias("status"))
    plan, done = ingest.settled(table_("plan", _planned(spark, sf_dir)), attempt, table_)
    return plan.join(done.withColumnRenamed("status", "copied"), "id", "left").select("id", "outcome", "is_duplicate", "matches", "dest_rel", "copied")


_OBSERVED_SQL = "count(*) AS files, CAST(coalesce(sum(file_size), 0) AS BIGINT) AS bytes, count(*) FILTER (WHERE status <> 'complete') AS failed"


@query("observed_counters", f"WITH {FILES_SQL} SELECT {_OBSERVED_SQL} FROM files")
def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a stage over all files, observed while it writes its table."""
    seen = progress.Observed()
    rows = files(spark, sf_dir).select("id", "status", F.col("file_size").alias("copied_bytes"))
    tables(spark, "observed")("done", seen.watch("copy", rows, execute.counters()))
    totals = seen.totals("copy")
    return spark.createDataFrame([(totals["files"], totals["bytes"], totals["failed"])], "files bigint, bytes bigint, failed bigint")


_VERIFY_SQL = """WITH named AS (SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN md5(text) WHEN 1 THEN sha1(text) WHEN 2 THEN sha256(text) WHEN 3 THEN repeat('0', 40) ELSE '' END AS expected, CASE doc_id % 5 WHEN 0 THEN 'md5' WHEN 2 THEN 'sha256' ELSE 'sha1' END AS algorithm,
 CASE doc_id % 5 WHEN 0 THEN md5(text) WHEN 2 THEN sha256(text) ELSE sha1(text) END AS actual FROM documents),
 v AS (SELECT id, CASE WHEN id % 5 <> 4 THEN algorithm END AS algorithm, coalesce(CASE WHEN id % 5 = 4 THEN '' ELSE expected END, '') AS expected, CASE WHEN id % 5 <> 4 THEN actual END AS actual, CASE WHEN id % 5 = 4 THEN 'unrecognised' WHEN expected = actual THEN 'verified' ELSE 'mismatch' END AS status FROM named)"""


def _verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    content, k = F.col("text").cast("binary"), F.col("doc_id") % 5
    known = F.when(k == 0, F.concat(F.lit("-0-"), F.md5(content))).when(k == 1, F.concat(F.lit("_"), F.sha1(content))).when(k == 2, F.concat(F.lit("-2-"), F.sha2(content, 256))).when(k == 3, F.lit("_" + "0" * 40)).otherwise(F.lit(""))
    media = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("20211225_062223"), known, F.lit(".jpg")).alias("name"), content.alias("content"))
    return verify.verified(media)


query("verify_archive", _VERIFY_SQL + " SELECT * FROM v")(lambda s, d: _verified(s, d).select("id", "algorithm", "expected", "actual", "status"))
query("verify_counters", _VERIFY_SQL + " SELECT " + ", ".join(_C(f"status = '{a}'", b) for a, b in (("verified", "verified"), ("mismatch", "mismatches"), ("unrecognised", "unrecognised"))) + " FROM v")(lambda s, d: verify.counters(_verified(s, d)))


@query(
    "verify_tree",
    """WITH m AS (SELECT doc_id, '20211225_062223-1-' || CASE WHEN doc_id % 4 = 1 THEN repeat('0', 40) ELSE sha1(coalesce(text, '')) END || CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.jpg' ELSE '' END AS name, doc_id % 3 = 1 AS known, doc_id % 4 <> 1 AS good FROM documents)
 SELECT doc_id, name, CASE WHEN NOT known THEN 'unrecognised' WHEN good THEN 'verified' ELSE 'mismatch' END AS status, CASE WHEN doc_id % 2 = 0 THEN ' [+xmp]' ELSE '' END AS sidecars FROM m
 UNION ALL SELECT doc_id, 'lone.xmp', 'unrecognised', '' FROM m WHERE doc_id % 2 = 1""",
)
def _verified_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, content = F.col("doc_id"), F.coalesce("text", F.lit("")).cast("binary")
    d = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"), F.concat(F.lit("/a/"), k).alias("dir"))
    checksum = F.when(k % 4 == 1, F.lit("0" * 40)).otherwise(F.sha1("content"))
    name = F.concat(F.lit("20211225_062223-1-"), checksum, F.when(k % 3 == 0, ".txt").when(k % 3 == 1, ".jpg").otherwise(""))
    media = d.select("dir", name.alias("name"), F.when(k % 3 == 1, "JPEG").alias("format"), "content")
    side = d.select("dir", F.when(k % 2 == 0, F.concat(name, F.lit(".xmp"))).otherwise("lone.xmp").alias("name"), F.lit("sidecar").alias("format"), F.lit(None).cast("binary").alias("content"))
    rows = media.unionByName(side).withColumn("path", F.concat_ws("/", "dir", "name"))
    return verify.whole_tree(rows, verify.verified).select(F.element_at(F.split("path", "/"), 3).cast("bigint").alias("doc_id"), "name", "status", "sidecars")


@query("still_skipped", _SIDECARS_SQL + """, found AS (SELECT DISTINCT s.dir || '/' || s.name AS path FROM side s JOIN media m ON m.dir = s.dir AND (lower(m.name) = lower(s.name[:-5]) OR lower(m.stem) = lower(s.name[:-5])))
 SELECT s.dir || '/' || s.name AS path FROM side s WHERE s.dir || '/' || s.name NOT IN (SELECT path FROM found)""")
def _still_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    media, side = _sidecar_inputs(spark, sf_dir)
    side = side.where("dir is not null")
    return sidecars.still_skipped(side.select("path"), sidecars.attached_on_ingest(media, side))


@query("file_status_fold", f"""WITH {FILES_SQL}, ev AS (SELECT user_id AS id, event_id AS seq, ts, CASE event_type WHEN 'view' THEN 'extracted' WHEN 'click' THEN 'hashed' WHEN 'purchase' THEN 'verified' WHEN 'signup' THEN 'complete' ELSE 'failed' END AS status FROM events),
 last AS (SELECT id, max_by(status, seq) AS status, max_by(ts, seq) FILTER (WHERE status = 'verified') AS verified_at FROM ev GROUP BY id)
 SELECT f.id, coalesce(l.status, f.status) AS status, coalesce(l.verified_at, f.verified_at) AS verified_at FROM files f LEFT JOIN last l ON f.id = l.id""")
def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    status = F.when(kind == "view", "extracted").when(kind == "click", "hashed").when(kind == "purchase", "verified").when(kind == "signup", "complete").otherwise("failed")
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), status.alias("status"), F.col("ts").alias("at"))
    full = files(spark, sf_dir).withColumns({c: F.lit(None).cast("timestamp_ntz") for c in ("extracted_at", "hashed_at", "copied_at", "tagged_at")})
    return store.applied(full, events).select("id", "status", "verified_at")


@query("complete_with_dedup", f"""WITH {FILES_SQL}, fin AS (SELECT id, checksum FROM files WHERE status IN ('pending', 'verified') AND checksum IS NOT NULL), firsts AS (SELECT checksum, min(id) AS first FROM fin GROUP BY checksum)
 SELECT f.id, CASE WHEN n.id IS NOT NULL THEN 'complete' ELSE f.status END AS status, CASE WHEN n.id IS NOT NULL THEN (EXISTS (SELECT 1 FROM files k WHERE k.status = 'complete' AND k.checksum = n.checksum)) OR n.id <> g.first ELSE f.is_duplicate END AS is_duplicate
 FROM files f LEFT JOIN fin n ON f.id = n.id LEFT JOIN firsts g ON n.checksum = g.checksum""")
def _completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return store.completed(f, f.where("status in ('pending', 'verified') and checksum is not null").select("id", "checksum")).select("id", "status", "is_duplicate")


# Streams: the same tables, read as a stream to its end


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parque[t]")


@query("stream_counters", "SELECT event_type, count(*) AS events FROM events GROUP BY event_type")
def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "counters")
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(f"{out}/table")
    stream = streams.counters(_event_stream(spark, sf_dir), "event_type")
    stream.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/table")


@query("stream_dedup", "SELECT event_type || '/' || user_id AS checksum, min(event_id) AS event_id FROM events GROUP BY 1")
def _stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_folder(spark, "dedup")
    stream = _event_stream(spark, sf_dir).select("event_id", F.concat_ws("/", "event_type", "user_id").alias("checksum"))
    state.into_table(state.first_seen(stream), f"{out}/table", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/table").select("checksum", "event_id")


def _in_batches(spark: SparkSession, rows: DataFrame, out: str, batch: Column, batches: int) -> DataFrame:
    """A stream that reads ``rows`` in so many micro-batches, in the order of their number ``batch``."""
    for k in range(batches):  # a file each, so that their times of writing follow the number
        rows.where(batch == k).coalesce(1).write.mode("append").parquet(f"{out}/source")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/source")


_WORKERS_SQL = "WITH l AS (SELECT user_id, max_by(event_type, event_id) AS kind, max_by(ts, event_id) AS ts FROM events GROUP BY user_id)"


@query("worker_states_streamed", _WORKERS_SQL + " SELECT user_id AS worker_id, kind, ts FROM l WHERE kind <> 'error' AND ts + INTERVAL 6 HOUR > (SELECT max(ts) - INTERVAL 10 SECOND FROM events)")
def _streamed_workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers by a stream of three micro-batches; those that were silent for six hours have expired."""
    out = shared_folder(spark, "workers")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", F.col("event_type").alias("kind"), F.col("user_id").alias("worker_id"), F.lit(None).cast("string").alias("path"))
    stream = _in_batches(spark, rows, out, F.pmod(F.xxhash64("event_id"), F.lit(3)), 3)
    state.into_table(state.worker_changes(stream, "6 hours"), f"{out}/table", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return state.current_workers(spark.read.parquet(f"{out}/table"), "6 hours").select("worker_id", "kind", "ts")


@query("byte_progress_streamed", """WITH e AS (SELECT ts, 'user_' || user_id AS path, event_id, event_id % 50 = 7 AS late FROM events), w AS (SELECT *, time_bucket(INTERVAL 100 MILLISECONDS, ts) AS start FROM e)
 SELECT start, path, max(event_id) AS bytes_done FROM w WHERE NOT late OR start + INTERVAL 100 MILLISECONDS > (SELECT max(ts) - INTERVAL 1 HOUR FROM e WHERE NOT late AND event_id % 2 = 1) GROUP BY 1, 2""")
def _streamed_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals in append mode. One of fifty events comes after all others: what is more than an hour late is dropped, by the
    watermark of the last micro-batch but one. A last event, a day later, closes the remaining intervals."""
    out = shared_folder(spark, "progress")
    rows = table(spark, sf_dir, "events").select("ts", F.concat(F.lit("user_"), "user_id").alias("path"), F.col("event_id").alias("bytes_done"), F.lit(1 << 40).alias("bytes_total"))
    end = rows.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts")).select("ts", F.lit("").alias("path"), F.explode(F.array(F.lit(0), F.lit(1)).cast("array<bigint>")).alias("bytes_done"), F.lit(1 << 40).alias("bytes_total"))
    batch = F.when(F.col("path") == "", F.col("bytes_done") + 3).when(F.col("bytes_done") % 50 == 7, 2).otherwise((F.col("bytes_done") + 1) % 2)
    stream = _in_batches(spark, rows.unionByName(end), out, batch, 5)
    done = streams.byte_progress(stream, late="1 hour").select(F.col("start").cast("timestamp_ntz").alias("start"), "path", "bytes_done")
    state.into_table(done, f"{out}/table", f"{out}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    # Not before: a filter on the key is pushed below the watermark, and the last events wouldn't move that.
    return spark.read.parquet(f"{out}/table").where("path != ''").select("start", "path", "bytes_done")


@query("observed_stream", "SELECT count(*) AS events, CAST(sum(event_id) AS BIGINT) AS ids, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events")
def _observed_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters that a listener sums up batch by batch while a stream runs."""
    out = shared_folder(spark, "observed")
    listener = progress.StreamProgress("counted")
    spark.streams.addListener(listener)
    try:
        watched = _event_stream(spark, sf_dir).observe("counted", F.count("*").alias("events"), F.sum("event_id").alias("ids"), F.count_if(F.col("event_type") == "error").alias("errors"))
        state.into_table(watched.select("event_id"), f"{out}/table", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
        listener.wait()
    finally:
        spark.streams.removeListener(listener)
    return spark.createDataFrame([(listener.totals["events"], listener.totals["ids"], listener.totals["errors"])], "events bigint, ids bigint, errors bigint")


query("worker_states", "WITH l AS (SELECT user_id, max_by(event_type, event_id) AS kind, max_by(ts, event_id) AS ts FROM events GROUP BY user_id) SELECT user_id AS worker_id, kind, ts FROM l WHERE kind <> 'error'")(
    lambda s, d: streams.worker_states(table(s, d, "events").select("event_id", F.col("ts"), F.col("event_type").alias("kind"), F.col("user_id").alias("worker_id"), F.lit(None).cast("string").alias("path"))).select("worker_id", "kind", "ts")
)
query("byte_progress", "SELECT time_bucket(INTERVAL 100 MILLISECONDS, ts) AS start, 'user_' || user_id AS path, max(event_id) AS bytes_done FROM events GROUP BY 1, 2")(
    lambda s, d: streams.byte_progress(table(s, d, "events").select("ts", F.concat(F.lit("user_"), "user_id").alias("path"), F.col("event_id").alias("bytes_done"), F.lit(1 << 40).alias("bytes_total"))).select(F.col("start").cast("timestamp_ntz").alias("start"), "path", "bytes_done")
)
