"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight and a weight schedule over training time 0..1. Its share of all tokens is its weight's; the
schedule's integral says which part of that share falls before a time t. A document's copies take consecutive stretches of
their source's token demand, and the inverse of the integral turns the middle of a stretch into a training position.

Documents of a source stand in the order of a hash of their id and text. Whole passes take every document once; the last,
partial pass takes those whose middle lies within the remaining demand. The running sums that this needs are made in two
levels, by (source, slice of the hash) and within one, so a source with a third of all rows is spread over many tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lines import WORD
from .scratch import Scratch

#: Weights of the sources in order, repeating; share of all sizes that the mix takes; most passes over a source.
WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
#: Schedules of the sources in order, repeating: (time, relative weight), linear between. Steady, rising, falling.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)), ((0.0, 1.5), (1.0, 0.5)))


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = WEIGHTS
    share: float = SHARE
    passes: int = PASSES
    schedules: tuple[tuple[tuple[float, float], ...], ...] = SCHEDULES


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def position(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """Time at which the schedule's integral reaches ``share`` of its whole, by solving each linear stretch's quadratic."""
    pieces, before = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        pieces.append((t0, t1 - t0, w0, w1, before, (t1 - t0) * (w0 + w1) / 2))
        before += pieces[-1][-1]
    whole, out = before, None
    for t0, width, w0, w1, start, area in pieces:
        need = share * whole - start
        slope = (w1 - w0) / width
        if abs(slope) < 1e-12:
            here = need / w0
        else:
            here = (F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * slope * need)) - w0) / slope
        here = F.lit(t0) + F.least(F.lit(width), F.greatest(F.lit(0.0), here))
        out = F.when(need <= area, here) if out is None else out.when(need <= area, here)
    return out.otherwise(F.lit(schedule[-1][0]))


def ranked(scratch: Scratch, sources: DataFrame) -> DataFrame:
    """``sources(of, source, source_size)`` with ``place`` from 0 by code point, null last, without a single-task window."""
    laid = sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id())
    laid = scratch.table("laid", laid).withColumns({"part": F.shiftright("at", 33), "row": F.col("at").bitwiseAND((1 << 33) - 1)})
    sizes = sorted((r["part"], r["n"]) for r in laid.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row per partition
    starts, before = [], 0
    for part, n in sizes:
        starts.append((part, before))
        before += n
    offsets = scratch.spark.createDataFrame(starts, "part bigint, start bigint")
    return laid.join(F.broadcast(offsets), "part").select("of", "source_size", (F.col("start") + F.col("row")).alias("place"))


def targets(scratch: Scratch, sources: DataFrame, mix: Mix) -> DataFrame:
    """``(of, source_size, place, target)``: weight-proportional, none above ``passes`` times its source's size.

    The excess of capped sources goes to the others by weight, again and again until no further source is capped; every
    round is one aggregate over the table of sources.
    """
    n = len(mix.weights)
    weight = F.lit(None)
    for k, w in enumerate(mix.weights):
        weight = F.when(F.col("place") % n == k, F.lit(float(w))).otherwise(weight)
    placed = scratch.table("sources", ranked(scratch, sources).withColumns({"weight": weight.cast("double"), "cap": mix.passes * F.col("source_size")}))
    total = mix.share * (placed.agg(F.sum("source_size").alias("n")).collect()[0]["n"] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("cap") <= F.col("weight") * F.lit(level)
        row = placed.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("cap"))).alias("taken"), F.sum(F.when(~full, F.col("weight"))).alias("open")).collect()[0]
        if row["n"] == capped:
            break
        capped = row["n"]
        level = (total - (row["taken"] or 0)) / row["open"] if row["open"] else float("inf")
    rest, open_ = float(total - (row["taken"] or 0)), row["open"] or 1.0
    return placed.select("of", "source_size", "place", F.when(full, F.col("cap").cast("double")).otherwise(F.col("weight") * F.lit(rest) / F.lit(open_)).alias("target"))


def mixed(docs: DataFrame, mix: Mix = Mix(), id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """``docs`` as the struct ``row`` (of the columns ``keep``, or all) with ``size``, ``source_size``, ``target``, ``taken`` and
    ``positions`` under the struct ``mix``.

    ``positions`` has a training time in 0..1 for every copy that the mix takes, so its length is 0, 1 or ``passes``.
    A null or word-less text has size 0 and takes nothing. A null source is a source of its own, the last. Ids may be null
    or repeat: only rows with equal id and text share a place in the order, stand in either order and lie in one slice.
    Texts are read for their sizes and hashes alone, unless they are kept; very long ones may exceed what is left of a target and
    are then taken or not by their middle. An empty table gives an empty one; columns come back in ``row``, whatever their names.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    id_, text, source = docs[id_col], docs[text_col], docs[source_col]
    key = F.md5(F.concat_ws(" ", id_.cast("string"), F.md5(text)))
    named = F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("")).alias("of")  # never null: joins and windows share one partitioning
    row = F.struct(*(docs[c] for c in (docs.columns if keep is None else keep))).alias("row")
    sized = docs.select(row, source.alias("source"), named, words(text).alias("size"), key.alias("key"))
    if keep is not None:
        sized = scratch.table("sized", sized)
    count = (docs if keep is None else sized).count()
    bits = min(32, max(1, math.ceil(math.log2(max(2, count)) / 2)))  # about as many slices as rows in one
    sized = sized.withColumn("slice", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint"), 32 - bits))

    slices = scratch.table("slices", sized.groupBy("of", "slice").agg(F.first("source").alias("source"), F.sum("size").alias("slice_size")))
    aims = targets(scratch, slices.groupBy("of").agg(F.first("source").alias("source"), F.sum("slice_size").alias("source_size")), mix)
    earlier = Window.partitionBy("of").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.withColumn("start", F.coalesce(F.sum("slice_size").over(earlier), F.lit(0)))
    starts = starts.join(aims, "of").select("of", "slice", "start", "source_size", "place", "target")

    within = Window.partitionBy("of", "slice").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(starts, ["of", "slice"])
    rows = rows.withColumn("middle", F.col("start") + F.col("ahead") + F.col("size") / 2)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rows = rows.withColumn("whole", F.least(whole, F.lit(mix.passes)).cast("int"))
    last = F.col("target") - F.col("whole") * F.col("source_size")
    copies = F.when(F.col("size") > 0, F.col("whole") + F.when((F.col("middle") <= last) & (F.col("whole") < mix.passes), 1).otherwise(0)).otherwise(0).cast("int")
    rows = rows.withColumn("copies", copies)
    reached = lambda k: F.least(F.lit(1.0), (F.col("middle") + k * F.col("source_size")) / F.col("target"))
    spots = []
    for k in range(mix.passes):
        at = F.lit(None).cast("double")
        for j, schedule in enumerate(mix.schedules):
            at = F.when(F.col("place") % len(mix.schedules) == j, position(reached(F.lit(k)), schedule)).otherwise(at)
        spots.append(F.when(F.col("copies") > k, at))
    positions = F.array_compact(F.array(*spots))
    out = F.struct("size", "source_size", "target", (F.col("copies") * F.col("size")).cast("bigint").alias("taken"), positions.alias("positions"))
    return rows.select("row", out.alias("mix"))


def curriculum(docs: DataFrame, mix: Mix = Mix(), **columns: str) -> DataFrame:
    """A row of ``docs`` for every copy that the mix takes, range-sorted by training position; ties stand in the order of a hash."""
    taken = mixed(docs, mix, **columns).select("row", F.explode("mix.positions").alias("position"))
    return taken.orderBy("position", F.xxhash64("row")).select("row.*")


#: The words of the mix by plain window sums over each whole source; targets by the sources in the order of cap to weight.
ORACLE_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5(concat_ws(' ', doc_id::VARCHAR, md5(text))) AS key FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sized GROUP BY source
), weighted AS (
  SELECT *, [5.0, 2.0, 1.0][(place % 3 + 1)::INT]::DOUBLE AS weight, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM sources
), prefixes AS (
  SELECT *, total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest, sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
         row_number() OVER o AS n
  FROM weighted WINDOW o AS (ORDER BY cap / weight, place)
), level AS (
  SELECT n, rest, open FROM prefixes WHERE cap > weight * (rest / open) ORDER BY n LIMIT 1
), aims AS (
  SELECT p.source, p.source_size, p.place, CASE WHEN l.n IS NULL OR p.n < l.n THEN p.cap::DOUBLE ELSE p.weight * l.rest / l.open END AS target
  FROM prefixes p LEFT JOIN level l ON true
), middles AS (
  SELECT s.doc_id, s.size, a.source_size, a.place, a.target,
         (coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + s.size / 2)::DOUBLE AS middle
  FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source
), passes AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 2)::INT ELSE 0 END AS whole FROM middles
), counted AS (
  SELECT *, CASE WHEN size > 0 THEN whole + CASE WHEN middle <= target - whole * source_size AND whole < 2 THEN 1 ELSE 0 END ELSE 0 END AS copies FROM passes
), reached AS (
  SELECT *, least(1.0::DOUBLE, (middle + 0 * source_size) / target) AS one, least(1.0::DOUBLE, (middle + 1 * source_size) / target) AS two FROM counted
), placed AS (
  SELECT *, CASE place % 3 WHEN 0 THEN one WHEN 1 THEN sqrt(0.25::DOUBLE + 2.0::DOUBLE * one) - 0.5::DOUBLE ELSE (sqrt(2.25::DOUBLE - 2.0::DOUBLE * one) - 1.5::DOUBLE) / -1.0::DOUBLE END AS first_place,
            CASE place % 3 WHEN 0 THEN two WHEN 1 THEN sqrt(0.25::DOUBLE + 2.0::DOUBLE * two) - 0.5::DOUBLE ELSE (sqrt(2.25::DOUBLE - 2.0::DOUBLE * two) - 1.5::DOUBLE) / -1.0::DOUBLE END AS second_place
  FROM reached
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, CASE WHEN copies > 0 THEN first_place END AS first_position, CASE WHEN copies > 1 THEN second_place END AS second_position
FROM placed
"""
