"""Intermediate tables in the folder that the whole cluster shares.

Lineage is cut by writing a Parquet table under ``spark.checkpoint.dir`` and reading it back, so that a lost executor
costs one read and never a recomputation of the stages before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalog.workdir import shared_folder


#: Spark's setting, read when a write begins, of whether its shuffles are deleted when it ends.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Named tables of one run of one operator. ``table`` writes and rereads, ``drop`` frees the disk of a consumed one."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.root = shared_folder(spark, what)

    def table(self, name: str, df: DataFrame, free_shuffles: bool = False) -> DataFrame:
        """``df``, written and reread. With ``free_shuffles`` what it shuffled is deleted as soon as it is written; else Spark
        deletes that when the driver happens to collect its garbage, and a later step's shuffles may lie beside it."""
        path = f"{self.root}/{name}"
        before = self.spark.conf.get(FREE_SHUFFLES, None)
        if free_shuffles:
            self.spark.conf.set(FREE_SHUFFLES, "true")
        try:
            df.write.mode("overwrite").parquet(path)
        finally:
            if free_shuffles and before is None:
                self.spark.conf.unset(FREE_SHUFFLES)
            elif free_shuffles:
                self.spark.conf.set(FREE_SHUFFLES, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
