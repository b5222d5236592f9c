"""Ingest as one plan: which files are taken, under which name, and why the others are not."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import gate_reason
from ..functions.paths import DEFAULT_TEMPLATE, destination
from ..operators.catalog import NO_DESTINATION
from ..skew import salted


def planned(
    candidates: DataFrame, files: DataFrame, stamp: str, algorithm: str = "sha1", template: str = DEFAULT_TEMPLATE, language: str = "en",
    since: dt.date | None = None, before: dt.date | None = None, skip_duplicates: bool = False,
) -> DataFrame:
    """``candidates`` with ``outcome`` (copy, duplicate, skip, error), ``reason``, ``is_duplicate``, ``matches`` and ``dest_rel``.

    Candidates have ``id, source_path, ext, checksum, capture_date, error`` (error: what extraction or hashing ran into).
    The order of decisions is: error, date gate, imported before, duplicate. Only files that pass the first three compete
    for being the first of their checksum, and a checksum that is complete in the catalogue makes all of its files
    duplicates. ``place`` is where a competing file would lie as an original, see ``settled``. Nothing is written.
    """
    done = files.where(F.col("status").isin("complete", "duplicate")).select("source_path", "checksum").distinct().withColumn("imported", F.lit(True))
    known = files.where("status = 'complete' and checksum is not null").groupBy("checksum").agg(F.min_by("dest_rel", F.struct(F.col("dest_rel").isNull(), "id")).alias("existing"), F.lit(True).alias("known"))
    rows = candidates.withColumn("gate", gate_reason(F.col("capture_date"), since, before)).join(done, ["source_path", "checksum"], "left")
    rows = rows.withColumn("competes", F.col("error").isNull() & F.col("gate").isNull() & F.col("imported").isNull())

    # What is known of a checksum meets the rows in one join, the plan's last: a checksum that a third of all rows share can be split there.
    name = destination(F.col("capture_date"), algorithm, F.col("checksum"), F.col("ext"), F.lit(False), F.lit(stamp), template, language)
    first = rows.where("competes").groupBy("checksum").agg(F.min("id").alias("first_id"), F.min_by(name, "id").alias("first_dest"))
    rows = rows.join(known.join(first, "checksum", "full"), "checksum", "left")
    duplicate = F.col("competes") & (F.coalesce("known", F.lit(False)) | (F.col("id") != F.col("first_id")))
    rows = rows.withColumn("is_duplicate", F.coalesce(duplicate, F.lit(False)))
    outcome = (
        F.when(F.col("error").isNotNull(), "error")
        .when(F.col("gate").isNotNull() | F.col("imported").isNotNull(), "skip")
        .when(F.col("is_duplicate"), "duplicate")
        .otherwise("copy")
    )
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("gate").isNotNull(), F.col("gate")).when(F.col("imported").isNotNull(), F.lit("previously imported"))
    matches = F.when(F.col("is_duplicate"), F.when(F.col("known"), F.coalesce(F.nullif("existing", F.lit("")), F.lit(NO_DESTINATION))).otherwise(F.col("first_dest")))
    place = destination(F.col("capture_date"), algorithm, F.col("checksum"), F.col("ext"), F.col("is_duplicate"), F.lit(stamp), template, language)
    written = F.col("competes") & ~(F.lit(skip_duplicates) & F.col("is_duplicate"))
    return rows.select(*candidates.columns, outcome.alias("outcome"), reason.alias("reason"), "is_duplicate", matches.alias("matches"), F.when(written, place).alias("dest_rel"), F.when(F.col("competes"), name).alias("place"))


def counters(plan: DataFrame) -> DataFrame:
    """``processed`` counts duplicates too."""
    of: Column = F.col("outcome")
    return plan.agg(F.count_if(of.isin("copy", "duplicate")).alias("processed"), F.count_if(of == "duplicate").alias("duplicates"), F.count_if(of == "skip").alias("skipped"), F.count_if(of == "error").alias("errors"))


def _next_copies(plan: DataFrame, lost: DataFrame) -> DataFrame:
    """``(checksum, id)``: for each of ``lost(checksum, after)`` the next file that was planned as a duplicate of it."""
    waiting = plan.where("outcome = 'duplicate'").select("checksum", "id")
    return salted(waiting, lost, ["checksum"], ["id"], how="inner").where("id > after").groupBy("checksum").agg(F.min("id").alias("id"))


def settled(plan: DataFrame, attempt: Callable[[DataFrame], DataFrame], table: Callable[[str, DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Copy, plan again and copy again until no first copy of a checksum fails; the plan as it came out and all results.

    ``attempt`` copies rows of a plan that have a ``dest_rel`` and returns ``(id, status, ...)``; ``table`` writes a table and reads it
    back, so that nothing is attempted twice because a later step reads it twice.

    First all originals are copied. Where one fails, the checksum's next file in id order, which was planned as its duplicate,
    becomes an original in its own place, and so on: a pass over the checksums that are still without one, which ends when
    all have one or no more files. Then the remaining duplicates are copied, as duplicates of the file that stayed. So
    every file ends as if files had come one by one. A checksum that the catalogue holds already has no original here, so
    its duplicates are never asked for.
    """
    originals = plan.where("outcome = 'copy'")
    done = [table("copied-0", attempt(originals))]
    lost = table("lost-0", originals.join(done[0].where("status != 'complete'").select("id"), "id", "left_semi").select("checksum", F.col("id").alias("after")))
    tried = []
    while lost.take(1):
        k = len(done)
        tried.append(table(f"next-{k}", _next_copies(plan, lost)))
        again = plan.join(tried[-1].select("id"), "id", "left_semi").withColumns({"outcome": F.lit("copy"), "is_duplicate": F.lit(False), "matches": F.lit(None).cast("string"), "dest_rel": F.col("place")})
        done.append(table(f"copied-{k}", attempt(again)))
        failed = done[-1].where("status != 'complete'").select("id")
        lost = table(f"lost-{k}", tried[-1].join(failed, "id", "left_semi").select("checksum", F.col("id").alias("after")))
    if tried:
        promoted = reduce(DataFrame.unionByName, tried)
        stayed = promoted.join(reduce(DataFrame.unionByName, done).where("status = 'complete'").select("id"), "id", "left_semi")
        stayed = stayed.join(plan.select("id", F.col("place").alias("new_matches")), "id").select("checksum", "new_matches")
        # Few checksums lose their first copy, so what is known of them may be repeated for every salt.
        out = salted(plan, stayed, ["checksum"], ["id"]).join(promoted.select("id", F.lit(True).alias("promoted")), "id", "left")
        own, other = F.coalesce("promoted", F.lit(False)), F.col("new_matches").isNotNull() & (F.col("outcome") == "duplicate")
        changes = {
            "matches": F.when(own, None).when(other, F.col("new_matches")).otherwise(F.col("matches")), "dest_rel": F.when(own, F.col("place")).otherwise(F.col("dest_rel")),
            "is_duplicate": F.col("is_duplicate") & ~own, "outcome": F.when(own, "copy").otherwise(F.col("outcome")),
        }
        plan = table("settled", out.withColumns(changes).select(plan.columns))
    done.append(table("copied-duplicates", attempt(plan.where("outcome = 'duplicate'"))))
    return plan, reduce(DataFrame.unionByName, done)
