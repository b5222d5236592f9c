"""Relations of the catalogue's shape over the driver's tables; whole tables, every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import destination

STAMP = "20260306_103000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(number: Column, *texts: str) -> Column:
    return F.element_at(F.array(*(F.lit(t) for t in texts)), (number % len(texts)).cast("int") + 1)


def ext(lang: Column) -> Column:
    return F.when(lang == "en", ".jpg").when(lang == "fr", ".JPEG").when(lang == "de", ".png").otherwise(".heic")


def capture(id_: Column) -> Column:
    return F.timestamp_add("MINUTE", id_ * 997, F.lit("2021-01-01 00:00:00").cast("timestamp_ntz"))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: the source is the run, the text's SHA-1 the checksum, the id sets status and messages."""
    id_, k = F.col("id"), F.floor(F.col("id") / 20)
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("run_id"), F.sha1("text").alias("checksum"), ext(F.col("lang")).alias("ext"), F.col("n_chars").alias("file_size"))
    status = F.when(id_ % 20 == 0, "failed").when(id_ % 20 == 1, "mismatch").when(id_ % 20 == 2, "tag_failed").when(id_ % 20 == 3, "skipped").when(id_ % 20 == 4, "pending").when(id_ % 20 == 5, "verified").otherwise("complete")
    d = d.withColumn("status", status)
    first = d.where("status = 'complete' and checksum is not null").groupBy("checksum").agg(F.min("id").alias("first_id"))
    d = d.join(first, "checksum", "left").withColumn("is_duplicate", F.coalesce((F.col("status") == "complete") & (id_ != F.col("first_id")), F.lit(False)))
    error = F.when(F.col("status") == "failed", _pick(k, "extract date: no EXIF data", "open hashable reader: bad box", "copy: no space left on device", "dedup check: locked", "promote: rename")).when(F.col("status") == "mismatch", F.lit("verify: checksum differs")).when(F.col("status") == "tag_failed", F.lit("tag write: refused"))
    reason = F.when(F.col("status") == "skipped", _pick(k, "unsupported format: .txt", "previously imported", "outside date range: before 2021-01-01", "orphan sidecar: no matching media file"))
    done = F.col("status") == "complete"
    d = d.withColumns({"capture_date": capture(id_), "error": error, "skip_reason": reason})
    rel = F.when(done & (id_ % 50 != 7), destination(F.col("capture_date"), "sha1", F.col("checksum"), F.col("ext"), F.col("is_duplicate"), F.lit(STAMP)))
    return d.select(
        "id", "run_id", F.concat(F.lit("/source/doc_"), id_.cast("string"), F.col("ext")).alias("source_path"), rel.alias("dest_rel"), "checksum",
        F.when(id_ % 7 != 0, F.lit("sha1")).alias("algorithm"), "skip_reason", "status", "is_duplicate", "capture_date", "file_size",
        F.when(done, F.timestamp_add("DAY", F.lit(30), F.col("capture_date"))).alias("verified_at"), "error", "ext",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of ``documents`` as runs; their number sets dates and status."""
    n = F.regexp_extract("id", "([0-9]+)", 1).cast("int")
    r = table(spark, sf_dir, "documents").where("source is not null").select(F.col("source").alias("id")).distinct().withColumn("n", n)
    status = F.when(F.col("n") % 3 == 0, "completed").when(F.col("n") % 3 == 1, "running").otherwise("interrupted")
    r = r.withColumns({"status": status, "started_at": F.timestamp_add("DAY", F.col("n"), F.lit("2021-06-01 08:00:00").cast("timestamp_ntz"))})
    return r.select(
        "id", F.concat(F.lit("1.0."), "n").alias("version"), F.concat(F.lit("/cards/"), F.col("n") % 4).alias("source"), F.lit("/archive").alias("destination"), F.lit("sha1").alias("algorithm"),
        (F.col("n") % 3 + 4).alias("workers"), (F.col("n") % 2 == 0).alias("recursive"), "started_at",
        F.when(F.col("n") % 3 == 0, F.timestamp_add("SECOND", F.col("n") * 61, F.col("started_at"))).alias("finished_at"), "status",
    )


def order_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``orders`` as runs and ``lineitem`` as their files."""
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("interrupted")
    return (
        table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), F.col("o_orderdate").alias("started_at"), status.alias("status")),
        table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id")),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as ledger entries: a user is a path, the event's kind its status."""
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "copy").when(kind == "signup", "duplicate").when(kind == "view", "skip").when(kind == "error", "error").otherwise(kind)
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("user_"), "user_id").alias("path"), F.col("event_id").alias("seq"), status.alias("status"), F.concat(F.lit("dest_"), "event_id").alias("destination"),
        F.concat(F.lit("match_"), "event_id").alias("matches"), F.concat(F.lit("reason_"), "event_id").alias("reason"),
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files of a new run: two thirds have new content, some have met an error."""
    id_ = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    content = F.concat(F.col("text"), F.when(id_ % 3 == 0, F.lit("")).otherwise(F.col("lang")))
    return d.select(
        (id_ + 1000000).alias("id"), F.concat(F.when(id_ % 2 == 0, "/source/doc_").otherwise("/card/doc_"), id_.cast("string"), ext(F.col("lang"))).alias("source_path"),
        ext(F.col("lang")).alias("ext"), F.sha1(content).alias("checksum"), capture(id_).alias("capture_date"), F.when(id_ % 11 == 0, F.lit("extract date: no EXIF data")).alias("error"),
    )


FILES_SQL = """
doc_base AS (
  SELECT doc_id AS id, source AS run_id, sha1(text) AS checksum, n_chars AS file_size,
         CASE lang WHEN 'en' THEN '.jpg' WHEN 'fr' THEN '.JPEG' WHEN 'de' THEN '.png' ELSE '.heic' END AS ext,
         CASE doc_id % 20 WHEN 0 THEN 'failed' WHEN 1 THEN 'mismatch' WHEN 2 THEN 'tag_failed' WHEN 3 THEN 'skipped' WHEN 4 THEN 'pending' WHEN 5 THEN 'verified' ELSE 'complete' END AS status,
         TIMESTAMP '2021-01-01' + to_minutes(doc_id * 997) AS capture_date
  FROM documents
), doc_first AS (SELECT checksum, min(id) AS first_id FROM doc_base WHERE status = 'complete' AND checksum IS NOT NULL GROUP BY checksum
), doc_dup AS (
  SELECT b.*, coalesce(b.status = 'complete' AND b.id <> f.first_id, false) AS is_duplicate FROM doc_base b LEFT JOIN doc_first f ON b.checksum = f.checksum
), files AS (
  SELECT id, run_id, '/source/doc_' || id || ext AS source_path,
         CASE WHEN status = 'complete' AND id % 50 <> 7 THEN (CASE WHEN is_duplicate THEN 'duplicates/20260306_103000/' ELSE '' END) || strftime(capture_date, '%Y/%m-%b/%Y%m%d_%H%M%S') || '-1-' || checksum || lower(ext) END AS dest_rel,
         checksum, CASE WHEN id % 7 <> 0 THEN 'sha1' END AS algorithm,
         CASE WHEN status = 'skipped' THEN CASE (id // 20) % 4 WHEN 0 THEN 'unsupported format: .txt' WHEN 1 THEN 'previously imported' WHEN 2 THEN 'outside date range: before 2021-01-01' ELSE 'orphan sidecar: no matching media file' END END AS skip_reason,
         status, is_duplicate, capture_date, file_size, CASE WHEN status = 'complete' THEN capture_date + INTERVAL 30 DAY END AS verified_at,
         CASE status WHEN 'failed' THEN CASE (id // 20) % 5 WHEN 0 THEN 'extract date: no EXIF data' WHEN 1 THEN 'open hashable reader: bad box' WHEN 2 THEN 'copy: no space left on device' WHEN 3 THEN 'dedup check: locked' ELSE 'promote: rename' END
                     WHEN 'mismatch' THEN 'verify: checksum differs' WHEN 'tag_failed' THEN 'tag write: refused' END AS error, ext
  FROM doc_dup
)"""

RUNS_SQL = """
run_base AS (SELECT DISTINCT source AS id, CAST(regexp_extract(source, '([0-9]+)', 1) AS INT) AS n FROM documents WHERE source IS NOT NULL
), runs AS (
  SELECT id, '1.0.' || n AS version, '/cards/' || (n % 4) AS source, '/archive' AS destination, 'sha1' AS algorithm, n % 3 + 4 AS workers, n % 2 = 0 AS recursive,
         TIMESTAMP '2021-06-01 08:00:00' + to_days(n) AS started_at,
         CASE WHEN n % 3 = 0 THEN TIMESTAMP '2021-06-01 08:00:00' + to_days(n) + to_seconds(n * 61) END AS finished_at,
         CASE n % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' ELSE 'interrupted' END AS status
  FROM run_base
)"""

LEDGER_SQL = """
entries AS (
  SELECT 'user_' || user_id AS path, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'copy' WHEN 'signup' THEN 'duplicate' WHEN 'view' THEN 'skip' WHEN 'error' THEN 'error' ELSE event_type END AS status,
         'dest_' || event_id AS destination, 'match_' || event_id AS matches, 'reason_' || event_id AS reason
  FROM events
), firm AS (SELECT path, max(seq) AS seq FROM entries WHERE status <> 'skip' GROUP BY path
), latest AS (SELECT path, max(seq) AS seq FROM entries GROUP BY path
), chosen AS (
  SELECT l.path, CASE WHEN e.status IN ('copy', 'duplicate') THEN f.seq ELSE l.seq END AS seq
  FROM latest l LEFT JOIN firm f ON l.path = f.path LEFT JOIN entries e ON e.path = f.path AND e.seq = f.seq
), folded AS (SELECT e.* FROM entries e JOIN chosen c ON e.path = c.path AND e.seq = c.seq)"""

CANDIDATES_SQL = """
candidates AS (
  SELECT doc_id + 1000000 AS id, (CASE WHEN doc_id % 2 = 0 THEN '/source/doc_' ELSE '/card/doc_' END) || doc_id || CASE lang WHEN 'en' THEN '.jpg' WHEN 'fr' THEN '.JPEG' WHEN 'de' THEN '.png' ELSE '.heic' END AS source_path,
         CASE lang WHEN 'en' THEN '.jpg' WHEN 'fr' THEN '.JPEG' WHEN 'de' THEN '.png' ELSE '.heic' END AS ext,
         sha1(CASE WHEN text IS NULL THEN NULL WHEN doc_id % 3 = 0 THEN text WHEN lang IS NULL THEN NULL ELSE text || lang END) AS checksum,
         TIMESTAMP '2021-01-01' + to_minutes(doc_id * 997) AS capture_date, CASE WHEN doc_id % 11 = 0 THEN 'extract date: no EXIF data' END AS error
  FROM documents
)"""
