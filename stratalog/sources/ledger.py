"""Ledger files (JSON lines) and legacy manifests as DataFrames."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import LEDGER_LINE

MOST_LINE = 1 << 20


class LineTooLong(ValueError):
    pass


def parsed(lines: DataFrame) -> DataFrame:
    """``(ledger, seq, LEDGER_LINE...)`` of ``lines(ledger, seq, value)``; blank and malformed lines are dropped.

    The header's own ``version`` text shares its key's meaning with the number, so it is read as ``tool_version``.
    """
    text = F.trim("value")
    entry = F.from_json(text, LEDGER_LINE.simpleString(), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    valid = F.try_parse_json(text).isNotNull() & text.startswith("{")
    return lines.where(valid).select("ledger", "seq", entry.alias("e")).select("ledger", "seq", "e.*")


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """One ledger file, whose name may be hidden; none if it is missing. A line over 1 MiB is an error."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8", errors="replace") as f:
        rows = [(path, i, line.rstrip("\n")) for i, line in enumerate(f)]
    if any(len(line.encode()) > MOST_LINE for _, _, line in rows):
        raise LineTooLong(f"{path}: a line is longer than {MOST_LINE} bytes")
    kind = T.StructType([T.StructField("ledger", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("value", T.StringType())])
    return parsed(spark.createDataFrame(rows, kind))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a legacy manifest document, with its header fields."""
    doc = spark.read.option("multiLine", "true").schema(
        "version int, source string, destination string, algorithm string, started_at string, workers int, files array<struct<source: string, destination: string, "
        "checksum: string, status: string, extracted_at: string, copied_at: string, verified_at: string, tagged_at: string, error: string>>"
    ).json(path)
    head = doc.select("source", "destination", "algorithm", "started_at", "workers", F.posexplode("files").alias("seq", "file"))
    return head.select(F.col("source").alias("run_source"), F.col("destination").alias("run_destination"), "algorithm", "started_at", "workers", "seq", "file.*")


class LedgerWriter:
    """Appends one run to a ledger file: a header, then entries; the file is synced when it is closed.

    Ledgers are secondary to the catalogue: after a failure it warns once and stays quiet.
    """

    def __init__(self, path: str, header: dict, warn=print):
        self.path, self.warn, self.file, self.muted = path, warn, None, False
        self._safely(lambda: setattr(self, "file", open(path, "a", encoding="utf-8")))  # noqa: SIM115
        self.write(header)

    def _safely(self, act) -> None:
        if not self.muted:
            try:
                act()
            except OSError as e:
                self.muted = True
                self.warn(f"ledger: {e}")

    def write(self, row: dict) -> None:
        line = json.dumps({k: v for k, v in row.items() if v is not None}, ensure_ascii=False, separators=(",", ":")) + "\n"
        self._safely(lambda: self.file.write(line))

    def close(self) -> None:
        def sync():
            self.file.flush()
            os.fsync(self.file.fileno())
            self.file.close()

        self._safely(sync)

    def __enter__(self) -> LedgerWriter:
        return self

    def __exit__(self, *_) -> None:
        self.close()
