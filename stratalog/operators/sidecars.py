"""Sidecar files: which media file each belongs to, on ingest and in the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import is_generated_sidecar
from ..functions.text import sidecar_order

ORPHAN = "orphan sidecar: no matching media file"


def attached_on_ingest(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Sidecars ``(dir, name, path)`` with ``media_path``, null for an orphan.

    A sidecar belongs to the media file of its directory whose whole name is the sidecar's without its extension, else to
    the one with that stem; case doesn't count, and of several the first discovered (``seq``) is taken. The extension
    is cut in lower case only, so an upper-case one leaves the name as it is.
    """
    cut = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    full = media.groupBy("dir", F.lower("name").alias("key")).agg(F.min_by("path", "seq").alias("by_name"))
    stem = media.groupBy("dir", F.lower(cut(F.col("name"))).alias("key")).agg(F.min_by("path", "seq").alias("by_stem"))
    key = F.lower(F.when(F.col("name").rlike(r"\.(xmp|aae)$"), F.left("name", F.length("name") - 4)).otherwise(F.col("name")))
    rows = sidecars.withColumn("key", key)
    rows = rows.join(full, ["dir", "key"], "left").join(stem, ["dir", "key"], "left")
    return rows.withColumn("media_path", F.coalesce("by_name", "by_stem")).drop("key", "by_name", "by_stem")


def attached_in_archive(media: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Sidecars with ``media_path``: their name is the media file's exact name and ``.xmp`` or ``.aae`` in any case."""
    known = media.groupBy("dir", F.col("name").alias("key")).agg(F.min_by("path", "seq").alias("media_path"))
    fits = F.lower(F.right("name", F.lit(4))).isin(".xmp", ".aae")
    return sidecars.withColumn("key", F.when(fits, F.left("name", F.length("name") - 4))).join(known, ["dir", "key"], "left").drop("key")


def orphans(attached: DataFrame) -> DataFrame:
    return attached.where("media_path is null").select("path", F.lit(ORPHAN).alias("reason"))


def still_skipped(skipped: DataFrame, attached: DataFrame) -> DataFrame:
    """Skipped files without those that turned out to be some media file's sidecars."""
    return skipped.join(attached.where("media_path is not null").select("path"), "path", "left_anti")


def orphaned_in_archive(tree: DataFrame, current_names: bool = False) -> DataFrame:
    """Generated sidecars of ``tree(path, name)`` whose media file isn't there."""
    generated = tree.where(is_generated_sidecar(F.col("name"), current_names)).select("path", F.left("path", F.length("path") - 4).alias("media"))
    return generated.join(tree.select(F.col("path").alias("media")), "media", "left_anti").select("path")


def extensions_by_media(attached: DataFrame) -> DataFrame:
    """``(media_path, extensions)``: each media file's sidecar extensions in canonical order."""
    ext = F.lower(F.regexp_extract("name", r"(\.[^.]*)$", 1))
    found = attached.where("media_path is not null").groupBy("media_path").agg(F.array_sort(F.collect_set(ext)).alias("found"))
    return found.select("media_path", sidecar_order(F.col("found")).alias("extensions"))
