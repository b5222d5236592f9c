"""Joins of rows with what is known of their key, where a key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that a key's rows are dealt over.
SALTS = 16


def salted(rows: DataFrame, known: DataFrame, on: list[str], by: list[str], salts: int = SALTS, how: str = "left") -> DataFrame:
    """``rows`` joined with ``known`` on ``on``; rows of one key go to ``salts`` tasks by a hash of the columns ``by``.

    ``known`` is repeated for every salt, so it should hold a row or a few per key, and only keys that need one. Both sides
    may come from the same stage: unlike adaptive splitting this doesn't need a written table, and the plan stays lazy.
    Rows with a null key are dealt too; they meet nothing.
    """
    salt = "_salt"
    many = known.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")).join(many, [*on, salt], how).drop(salt)


#: A key that holds more than this part of all rows is hot: there are fewer than this many such keys.
HOT_PARTS, HOT_SALTS = 1000, 64


def with_known(rows: DataFrame, known: DataFrame, on: str, by: list[str], n: str = "n", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` left-joined with ``known``, which has one row per key ``on`` and in ``n`` how many of ``rows`` hold it.

    The keys that hold more than a thousandth of what ``n`` adds up to, fewer than a thousand, are broadcast to the rows: these
    rows, and those with a null key, are dealt by a hash of the columns ``by``, and only what is known of hot keys is repeated
    for the salts. ``counts`` may give keys and ``n`` where ``known`` itself is dear to compute. The plan stays lazy.
    """
    counts = known.select(on, n) if counts is None else counts.select(on, n)
    hot = F.col(n) * HOT_PARTS > counts.agg(F.sum(n)).scalar()
    keys = F.broadcast(counts.where(hot).select(F.col(on).alias("_hot_key"), F.lit(True).alias("_hot")))
    deal = lambda salts: F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int")
    salt = F.when(F.col(on).isNull(), deal(1 << 16)).when(F.col("_hot"), deal(HOT_SALTS)).otherwise(0)
    dealt = rows.join(keys, F.col(on) == F.col("_hot_key"), "left").withColumn("_salt", salt)
    repeated = known.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(HOT_SALTS - 1))).otherwise(F.array(F.lit(0)))))
    values = [c for c in known.columns if c not in (on, n)]
    return dealt.join(repeated.drop(n), [on, "_salt"], "left").select(*rows.columns, *values)
