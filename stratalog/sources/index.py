"""An index of the catalogue by checksum: a bucketed, sorted table that small batches are looked up in.

The index has a row per checksum and is bucketed and sorted by it, so it is neither shuffled nor sorted when a batch meets it:
the batch's distinct checksums are sent to its buckets. Before that, a Bloom filter of the batch, of fixed size, drops
nearly all of the index's rows where they are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import NO_DESTINATION, first_complete
from ..skew import with_known

#: Bits of a Bloom filter and probes per key: 1 MB, of which a batch of 100,000 checksums sets a fortieth.
BITS, PROBES = 1 << 23, 2
BUCKETS = 256


def _probes(key: Column) -> list[Column]:
    """Positions of a key's bits."""
    return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(BITS)) for k in range(PROBES)]


def bloom_filter(keys: DataFrame, key: str) -> Column:
    """The filter of all values of a column, as an array of 64-bit words that is computed once; nulls aren't in it."""
    at = keys.where(F.col(key).isNotNull()).select(F.explode(F.array(*_probes(F.col(key)))).alias("at"))
    words = at.groupBy(F.expr("at div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("bits"))
    every = keys.sparkSession.range(BITS // 64).select(F.col("id").alias("word"))
    dense = every.join(words, "word", "left").agg(F.sort_array(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits")))).alias("all"))
    return dense.select(F.col("all.bits").alias("bits")).scalar()


def may_hold(bits: Column, key: Column) -> Column:
    """Whether a key may be in the filter; never false for one that is."""
    out = F.lit(True)
    for at in _probes(key):
        out = out & (F.getbit(F.get(bits, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
    return out


def write(files: DataFrame, table: str, path: str, buckets: int = BUCKETS) -> None:
    """Index ``files`` as the table ``table`` at ``path``: ``(checksum, dest, known)``, see ``catalog.first_complete``."""
    rows = first_complete(files).repartition(buckets, "checksum")  # a task per bucket, so that each is one sorted file
    rows.write.mode("overwrite").option("path", path).bucketBy(buckets, "checksum").sortBy("checksum").saveAsTable(table)


def lookup(spark: SparkSession, candidates: DataFrame, table: str, buckets: int = BUCKETS) -> DataFrame:
    """``candidates`` with ``existing``, like ``catalog.known_copies`` on the files that ``table`` indexes in so many buckets.

    The batch is dealt to the buckets' number: Spark would rather shuffle the index too than join with fewer partitions than
    it shuffles into.
    """
    asked = candidates.where("checksum is not null").groupBy("checksum").agg(F.count("*").alias("n"))
    near = spark.table(table).where(may_hold(bloom_filter(asked, "checksum"), F.col("checksum")))
    found = asked.repartition(buckets, "checksum").hint("merge").join(near, "checksum", "left").where("known or n > 1")
    place = F.coalesce(F.nullif("dest", F.lit("")), F.lit(NO_DESTINATION))
    return with_known(candidates, found, "checksum", candidates.columns, counts=asked).withColumn("existing", F.when(F.col("known"), place)).drop("dest", "known")
