"""Capture dates: EXIF text, container epochs, and the date gate of an ingest."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the date of a file that has none.
UNKNOWN = dt.datetime(1902, 2, 20)
CONTAINER_EPOCH = dt.datetime(1904, 1, 1)


def exif_date(text: Column) -> Column:
    """``2006:01:02 15:04:05`` after trimming, as it stands; null if it isn't that."""
    shape = r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}$"
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(shape), F.try_to_timestamp(trimmed, F.lit("yyyy:MM:dd HH:mm:ss")).cast("timestamp_ntz"))


def capture_date(original: Column, modified: Column) -> Column:
    """The original date, else the file's, else ``UNKNOWN``."""
    return F.coalesce(exif_date(original), exif_date(modified), F.lit(UNKNOWN).cast("timestamp_ntz"))


def container_date(seconds: Column) -> Column:
    """Seconds since 1904; 0 and null mean ``UNKNOWN``."""
    at = F.timestamp_add("SECOND", seconds, F.lit(CONTAINER_EPOCH).cast("timestamp_ntz"))
    return F.when(F.coalesce(seconds, F.lit(0)) == 0, F.lit(UNKNOWN).cast("timestamp_ntz")).otherwise(at)


def text_chunk_date(text: Column) -> Column:
    """Creation times of image text chunks in the layouts that writers use; the clock time as written, whatever its zone."""
    at = F.trim(text)
    days, months = "(Mon|Tue|Wed|Thu|Fri|Sat|Sun)", "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    mail = F.when(at.rlike(rf"^{days}, \d{{2}} {months} \d{{4}} \d{{2}}:\d{{2}}:\d{{2}} ([A-Z]{{3,4}}|[+-]\d{{4}})$"), F.try_to_timestamp(F.substring(at, 6, 20), F.lit("dd MMM yyyy HH:mm:ss")))
    iso = F.when(at.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"), F.try_to_timestamp(F.left(at, F.lit(19)), F.lit("yyyy-MM-dd'T'HH:mm:ss")))
    plain = F.when(at.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.try_to_timestamp(at, F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.coalesce(mail.cast("timestamp_ntz"), iso.cast("timestamp_ntz"), exif_date(at), plain.cast("timestamp_ntz"))


def gate_reason(captured: Column, since: dt.date | None, before: dt.date | None) -> Column:
    """Why a capture date is outside ``since..before`` (whole days, both inclusive); null if it isn't."""
    out = F.lit(None).cast("string")
    if before is not None:
        end = dt.datetime.combine(before, dt.time.max)
        out = F.when(captured > F.lit(end).cast("timestamp_ntz"), F.lit(f"outside date range: after {before:%Y-%m-%d}")).otherwise(out)
    if since is not None:
        start = dt.datetime.combine(since, dt.time.min)
        out = F.when(captured < F.lit(start).cast("timestamp_ntz"), F.lit(f"outside date range: before {since:%Y-%m-%d}")).otherwise(out)
    return out
