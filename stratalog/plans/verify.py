"""Verification of an archive: the checksum in each name against the file's bytes, by the algorithm the name gives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import NATIVE, content_hash, file_digest, other_digest
from ..functions.paths import parsed_name
from ..functions.text import sidecar_note
from ..operators import sidecars


def _named(media: DataFrame, default: str, recognised: Column | None) -> DataFrame:
    """``media`` with ``expected``, ``algorithm`` and ``ok``, each evaluated once: a generator's output isn't inlined."""
    rows = media.withColumn("_known", F.lit(True) if recognised is None else recognised)
    parsed = F.inline(F.array(parsed_name(F.col("name")))).alias("expected", "algorithm", "ok")
    rows = rows.select(*media.columns, "_known", parsed)
    ok = F.coalesce(F.col("ok") & F.col("_known"), F.lit(False))
    return rows.withColumns({"ok": ok, "algorithm": F.coalesce(F.nullif(F.col("algorithm"), F.lit("")), F.lit(default))}).drop("_known")


def _judged(rows: DataFrame, actual: Column, columns: list[str]) -> DataFrame:
    rows = rows.withColumn("actual", actual)
    status = F.when(~F.col("ok"), "unrecognised").when(F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)), "verified").otherwise("mismatch")
    return rows.select(*columns, F.when(F.col("ok"), F.col("algorithm")).alias("algorithm"), "expected", "actual", status.alias("status"))


def verified(media: DataFrame, default: str = "sha1", content: str = "content", recognised: Column | None = None) -> DataFrame:
    """``media(path, name, <content>)`` with ``expected``, ``actual`` and ``status``: verified, mismatch or unrecognised.

    A name that can't tell its algorithm is checked by ``default``. Bytes that can't be read (null) are a mismatch; rows for
    which ``recognised`` doesn't hold are unrecognised, whatever their name. One pass: only the bytes of rows whose
    algorithm has no native form leave the JVM.
    """
    rows, bytes_ = _named(media, default, recognised), F.col(content)
    other = F.col("ok") & ~F.col("algorithm").isin(*NATIVE)
    actual = other_digest(F.when(other, bytes_), F.col("algorithm"))
    for name in NATIVE:
        actual = F.when(F.col("ok") & (F.col("algorithm") == name), content_hash(bytes_, name)).otherwise(actual)
    return _judged(rows, actual, [c for c in media.columns if c != content])


def verified_files(media: DataFrame, default: str = "sha1", recognised: Column | None = None) -> DataFrame:
    """``verified`` for ``media(path, name)`` whose files the executors read in blocks, so that their size doesn't matter."""
    rows = _named(media, default, recognised)
    return _judged(rows, file_digest(F.when(F.col("ok"), F.col("path")), F.col("algorithm")), media.columns)


def whole_tree(rows: DataFrame, check: Callable[..., DataFrame], default: str = "sha1") -> DataFrame:
    """Every file of ``rows(path, dir, name, format, ...)`` with its status by ``check``, and the ``sidecars`` of media files as a note.

    What has no known format or no generated name is unrecognised, and so is a sidecar without its media file.
    """
    is_sidecar = F.coalesce(F.col("format") == "sidecar", F.lit(False))
    media = rows.where(~is_sidecar)
    attached = sidecars.attached_in_archive(media.withColumn("seq", F.col("path")), rows.where(is_sidecar).select("path", "dir", "name"))
    notes = sidecars.extensions_by_media(attached).select(F.col("media_path").alias("path"), sidecar_note(F.col("extensions")).alias("sidecars"))
    checked = check(media.drop("dir"), default, recognised=F.col("format").isNotNull()).select("path", "name", "algorithm", "expected", "actual", "status")
    checked = checked.join(notes, "path", "left").withColumn("sidecars", F.coalesce("sidecars", F.lit("")))
    orphans = attached.where("media_path is null").select("path", "name", F.lit("unrecognised").alias("status"), F.lit("").alias("expected"), F.lit("").alias("sidecars"))
    return checked.unionByName(orphans, allowMissingColumns=True)


def counters(result: DataFrame) -> DataFrame:
    return result.agg(*(F.count_if(F.col("status") == s).alias(n) for s, n in (("verified", "verified"), ("mismatch", "mismatches"), ("unrecognised", "unrecognised"))))
