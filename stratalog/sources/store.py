"""The catalogue on disk: Parquet tables, their migrations, import from SQLite, and where a catalogue lies."""

from __future__ import annotations

import os
import shutil
import sqlite3

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import slug
from ..operators.catalog import backfilled_algorithm
from ..schemas import FILES, RUNS
from ..skew import with_known
from ..workdir import numbered, tables

VERSION = 5
#: Columns that a table's folders are named by: what changes in one run leaves the others' files alone.
PARTITIONED = {"runs": (), "files": ("run_id",)}


class Store:
    """Tables ``runs``, ``files`` and ``schema_version`` under one folder.

    ``files`` has a folder per run. Rows are appended, or the folders of the runs that an update touches are overwritten, or a
    table is rewritten as a whole: that goes to a new generation folder, and the pointer file is replaced last, so readers
    see either the old or the new table. Ids are given out in order and a run's files have ids of their own.
    """

    def __init__(self, spark: SparkSession, path: str, create: bool = True):
        self.spark, self.path = spark, path
        if create:
            os.makedirs(path, exist_ok=True)
            if not any(os.path.exists(self._pointer(name)) for name in PARTITIONED):
                replace_text(os.path.join(path, "schema_version"), str(VERSION))
            for name, schema in (("runs", RUNS), ("files", FILES)):
                if not os.path.exists(self._pointer(name)):
                    self.replace(name, spark.createDataFrame([], schema))
            self.migrate()
        elif not os.path.isdir(path):
            raise FileNotFoundError(f"no catalogue at {path}")

    def _pointer(self, name: str) -> str:
        return os.path.join(self.path, f"{name}.current")

    def _folder(self, name: str) -> str:
        with open(self._pointer(name), encoding="utf-8") as f:
            return os.path.join(self.path, f.read())

    def read(self, name: str) -> DataFrame:
        schema = {"runs": RUNS, "files": FILES}[name]
        if not self._current():
            return self.spark.read.parquet(self._folder(name))  # what an older catalogue lacks is seen by its columns
        return self.spark.read.schema(schema).parquet(self._folder(name)).select(*schema.names)  # names of folders are no numbers

    @property
    def runs(self) -> DataFrame:
        return self.read("runs")

    @property
    def files(self) -> DataFrame:
        return self.read("files")

    def append(self, name: str, rows: DataFrame) -> None:
        self._writer(name, rows).mode("append").parquet(self._folder(name))

    @staticmethod
    def _writer(name: str, rows: DataFrame):
        return rows.write.partitionBy(*PARTITIONED[name]) if PARTITIONED[name] else rows.write

    def _current(self) -> bool:
        try:
            with open(os.path.join(self.path, "schema_version"), encoding="utf-8") as f:
                return int(f.read()) >= VERSION
        except FileNotFoundError:
            return False

    def replace(self, name: str, rows: DataFrame) -> None:
        number = 0
        while os.path.exists(os.path.join(self.path, f"{name}-{number}")):
            number += 1
        self._writer(name, rows).parquet(os.path.join(self.path, f"{name}-{number}"))
        replace_text(self._pointer(name), f"{name}-{number}")

    def insert_files(self, rows: DataFrame, order: str) -> None:
        """Append pending files with ids after the largest, in the order of ``order`` (which has no ties)."""
        last = self.files.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).collect()[0]["n"]
        laid = numbered(tables(self.spark, "insert"), rows, [order]).withColumn("id", F.col("seq") + 1 + last)
        missing = {f.name: F.lit(None).cast(f.dataType) for f in FILES if f.name not in laid.columns}
        missing["status"], missing["is_duplicate"] = F.lit("pending"), F.lit(False)
        self.append("files", laid.withColumns(missing).select(*(F.col(f.name).cast(f.dataType) for f in FILES)))

    def finish_run(self, run_id: str, status: str, finished_at) -> None:
        """Complete or interrupt a run; an unknown id is an error."""
        if not self.runs.where(F.col("id") == run_id).take(1):
            raise LookupError(f"no run {run_id}")
        hit = F.col("id") == run_id
        self.replace("runs", self.runs.withColumns({"status": F.when(hit, F.lit(status)).otherwise(F.col("status")), "finished_at": F.when(hit, F.lit(finished_at).cast("timestamp_ntz")).otherwise(F.col("finished_at"))}))

    def update_files(self, events: DataFrame) -> None:
        """Fold status events ``(id, seq, status, at, ...)`` into the files; see ``applied``. Only the touched runs are rewritten."""
        table = tables(self.spark, "update")
        events = table("events", events)
        runs = table("runs", self.files.join(events.select("id").distinct(), "id", "left_semi").select("run_id").distinct())
        changed = table("changed", applied(self.files.join(runs, "run_id", "left_semi").select(FILES.names), events))
        self._writer("files", changed).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self._folder("files"))

    def complete_files(self, finishing: DataFrame) -> None:
        """Complete ``finishing(id, checksum)``, of equal checksums only the first as an original; see ``completed``. Only the
        touched runs are rewritten; the others are read for their checksums."""
        table = tables(self.spark, "complete")
        finishing = table("finishing", finishing)
        runs = table("runs", self.files.join(finishing.select("id").distinct(), "id", "left_semi").select("run_id").distinct())
        changed = table("changed", completed(self.files, finishing).join(runs, "run_id", "left_semi").select(FILES.names))
        self._writer("files", changed).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(self._folder("files"))

    def compact(self) -> None:
        """Rewrite both tables into as few files as their size needs, unless a run is active."""
        if self.runs.where("status = 'running'").take(1):
            raise RuntimeError("a run is active")
        for name in ("runs", "files"):
            old = self._folder(name)
            rows = self.read(name)
            self.replace(name, rows.hint("rebalance", *PARTITIONED[name]) if PARTITIONED[name] else rows.repartition(1))
            shutil.rmtree(old)

    def migrate(self) -> None:
        """Add what older catalogues lack; a catalogue of the current version is left alone."""
        if self._current():
            return
        runs, files = migrated(self.runs, self.files)
        if runs.columns != self.runs.columns:
            self.replace("runs", runs)
        self.replace("files", files)  # into a folder per run
        replace_text(os.path.join(self.path, "schema_version"), str(VERSION))


#: The time column that a status sets.
STAMPS = {"extracted": "extracted_at", "hashed": "hashed_at", "copied": "copied_at", "verified": "verified_at", "tagged": "tagged_at"}


def applied(files: DataFrame, events: DataFrame) -> DataFrame:
    """``files`` after ``events(id, seq, status, at, fields...)``: the last status, each stamp's last time, and the last
    value of every optional field that an event sets. Events of unknown ids have no effect."""
    optional = [c for c in events.columns if c not in ("id", "seq", "status", "at") and c in files.columns]
    last = lambda value, when: F.max_by(value, F.when(when, F.col("seq")))
    folds = [F.max_by("status", "seq").alias("new_status")]
    folds += [last(F.col("at"), F.col("status") == s).alias(f"new_{c}") for s, c in STAMPS.items()]
    folds += [last(F.col(c), F.col(c).isNotNull()).alias(f"new_{c}") for c in optional]
    joined = files.join(events.groupBy("id").agg(*folds), "id", "left")
    changed = {c: F.coalesce(f"new_{c}", c) for c in ("status", *STAMPS.values(), *optional)}
    return joined.withColumns(changed).select(files.columns)


def completed(files: DataFrame, finishing: DataFrame) -> DataFrame:
    """``files`` with those of ``finishing(id, checksum)`` completed: of equal checksums the first by id stays an original,
    unless the catalogue has a complete file of that checksum already; all others are complete duplicates."""
    finishing = finishing.where("checksum is not null")
    first = finishing.groupBy("checksum").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    known = files.where("status = 'complete' and checksum is not null").select("checksum").distinct().withColumn("known", F.lit(True))
    shared = first.join(known, "checksum", "left").where("n > 1 or known")  # the others are alone and new
    verdict = with_known(finishing, shared, "checksum", ["id"], counts=first)
    dup = F.coalesce("known", F.lit(False)) | F.coalesce(F.col("id") != F.col("first"), F.lit(False))
    verdict = verdict.select("id", F.col("checksum").alias("new_checksum"), dup.alias("dup"))
    joined = files.join(verdict, "id", "left")
    hit = F.col("dup").isNotNull()
    return joined.withColumns({"status": F.when(hit, F.lit("complete")).otherwise(F.col("status")), "checksum": F.coalesce("new_checksum", "checksum"), "is_duplicate": F.when(hit, F.col("dup")).otherwise(F.col("is_duplicate"))}).select(files.columns)


def migrated(runs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables of an older version with the columns of the current one; a file without an algorithm takes its run's."""
    if "recursive" not in runs.columns:
        runs = runs.withColumn("recursive", F.lit(False))
    for name, kind in (("skip_reason", "string"), ("carried_sidecars", "array<string>"), ("algorithm", "string")):
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast(kind))
            if name == "algorithm":
                files = backfilled_algorithm(files, runs)
    return runs.select([f.name for f in RUNS]), files.select([f.name for f in FILES])


def imported_manifest(entries: DataFrame, run_id: str, now) -> tuple[DataFrame, DataFrame]:
    """A legacy manifest as ``(runs, files)``: one completed run; stage times are the time of import."""
    at = F.lit(now).cast("timestamp_ntz")
    run = entries.select(
        F.lit(run_id).alias("id"), F.lit("migrated").alias("version"), F.col("run_source").alias("source"), F.col("run_destination").alias("destination"), "algorithm",
        "workers", F.lit(False).alias("recursive"), F.to_timestamp_ntz(F.regexp_replace("started_at", "Z$", "")).alias("started_at"), at.alias("finished_at"), F.lit("completed").alias("status"),
    ).distinct()
    relative = F.when(F.col("destination").startswith(F.concat("run_destination", F.lit("/"))), F.substr("destination", F.length("run_destination") + 2)).otherwise(F.col("destination"))
    stamp = lambda c: F.when(F.col(c).isNotNull(), at).alias(c)
    files = entries.select(
        (F.col("seq") + 1).cast("bigint").alias("id"), F.lit(run_id).alias("run_id"), F.col("source").alias("source_path"), F.col("destination").alias("dest_path"), relative.alias("dest_rel"),
        "checksum", "algorithm", F.lit(None).cast("string").alias("skip_reason"), "status", F.coalesce(F.col("destination").contains("duplicates/"), F.lit(False)).alias("is_duplicate"),
        F.lit(None).cast("timestamp_ntz").alias("capture_date"), F.lit(None).cast("bigint").alias("file_size"), stamp("extracted_at"), F.lit(None).cast("timestamp_ntz").alias("hashed_at"),
        stamp("copied_at"), stamp("verified_at"), stamp("tagged_at"), "error", F.lit(None).cast("array<string>").alias("carried_sidecars"),
    )
    return run, files


def import_sqlite(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(runs, files)`` of a SQLite catalogue file, of any version, through the standard library."""
    out = []
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        for name, schema in (("runs", RUNS), ("files", FILES)):
            cursor = db.execute(f"SELECT * FROM {name}")
            names = [c[0] for c in cursor.description]
            rows = [tuple(None if v is None else str(v) for v in row) for row in cursor]
            df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
            for f in schema:
                if f.name in names:
                    kind, text = f.dataType.simpleString(), F.col(f.name)
                    value = F.to_timestamp_ntz(F.regexp_replace(text, "Z$", "")) if kind == "timestamp_ntz" else F.from_json(text, "array<string>") if kind.startswith("array") else (text == "1") if kind == "boolean" else text.cast(kind)
                    df = df.withColumn(f.name, value)
            out.append(df)
    return migrated(*out)


MARKER = ".catalog-location"
#: File system types that lie on a network.
NETWORK = ("nfs", "nfs4", "cifs", "smb", "smb2", "smb3", "smbfs")


def on_network_mount(path: str, mounts: str = "/proc/mounts") -> bool:
    """Whether the mount that holds ``path`` is a network file system; False where that can't be told."""
    path, best = os.path.realpath(path), ("", "")
    try:
        with open(mounts, encoding="utf-8", errors="replace") as f:
            for line in f:
                parts = line.split()
                if len(parts) > 2:
                    point = parts[1].replace("\\040", " ")
                    if (path == point or path.startswith(point.rstrip("/") + "/")) and len(point) >= len(best[0]):
                        best = point, parts[2]
    except OSError:
        return False
    return best[1] in NETWORK


def locate(spark: SparkSession, archive: str, explicit: str | None = None, marker: str = MARKER, on_network: bool | None = None, home: str | None = None, write_marker: bool = False) -> str:
    """Where an archive's catalogue is: the given path, else what the archive's marker file names, else under the home
    folder for an archive on a network mount, else inside the archive.

    With ``write_marker`` a place outside the archive is noted in the marker, so that later commands find it.
    """
    named = os.path.join(archive, marker)
    if explicit:
        found = os.path.abspath(explicit)
    else:
        if os.path.isfile(named):
            with open(named, encoding="utf-8") as f:
                if text := f.read().strip():
                    return text
        if not (on_network_mount(archive) if on_network is None else on_network):
            return os.path.join(archive, ".stratalog", "catalog")
        name = spark.range(1).select(slug(F.lit(os.path.abspath(archive))).alias("s")).collect()[0]["s"]
        found = os.path.join(home or os.path.expanduser("~"), ".stratalog", name)
    if write_marker:
        os.makedirs(archive, exist_ok=True)
        replace_text(named, found)
    return found


def exported(files: DataFrame) -> DataFrame:
    """``files`` with the carried sidecars as a JSON array, null for none, as flat catalogue files keep them."""
    return files.withColumn("carried_sidecars", F.when(F.size("carried_sidecars") > 0, F.to_json("carried_sidecars")))


def folder_size(path: str) -> int:
    return sum(os.path.getsize(os.path.join(at, name)) for at, _, names in os.walk(path) for name in names)


def replace_text(path: str, text: str) -> None:
    """Write a small file so that readers see the old or the new one, never a part."""
    temporary = f"{path}.tmp"
    with open(temporary, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(temporary, path)
