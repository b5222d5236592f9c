"""The folder that the whole cluster shares, for intermediate tables and stream checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; only in local mode a temporary folder stands in for it."""
    root = spark.conf.get(SETTING, None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{SETTING} must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="stratalog-")
        spark.conf.set(SETTING, root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def numbered(table: Callable[[str, DataFrame], DataFrame], rows: DataFrame, order: list[str | Column], name: str = "seq") -> DataFrame:
    """``rows`` with gapless numbers from 0 in the order of ``order``, without a single task that sees all rows.

    ``table`` writes a named table and reads it back: numbers follow from a row's place in its sorted part, which is fixed
    once it is written. Only a row per part meets in one task.
    """
    laid = table(f"{name}-laid", rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    laid = laid.withColumns({"_part": F.shiftright("_at", 33), "_row": F.col("_at").bitwiseAND((1 << 33) - 1)})
    sizes = laid.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    return laid.join(starts, "_part").select(*rows.columns, (F.col("_start") + F.col("_row")).cast("bigint").alias(name))


def tables(spark: SparkSession, what: str) -> Callable[[str, DataFrame], DataFrame]:
    """Writes named tables into a new shared folder and reads them back, so that neither a lost executor nor what happens to
    their inputs later changes them."""
    folder = shared_folder(spark, what)

    def table(name: str, rows: DataFrame) -> DataFrame:
        rows.write.parquet(f"{folder}/{name}")
        return spark.read.schema(rows.schema).parquet(f"{folder}/{name}")

    return table
