"""Rules as tables: ignore patterns by scope, and diagnosis rules by message. However many there are, a row meets those alone
that share a key with it: a folder above it, or a few characters of its message."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.globs import to_regex
from ..skew import salted, with_known

#: Characters of a message and a pattern that have to be equal for them to meet.
GRAM = 4


def _regex(pattern: Column) -> Column:
    return F.pandas_udf(lambda patterns: pd.Series([to_regex(p) for p in patterns], dtype=object), "string")(pattern)


def hidden(rows: DataFrame, scopes: DataFrame, folders: bool = False, name: str = "name", relative: str = "rel") -> DataFrame:
    """``rows`` with ``hidden``: whether a pattern of ``scopes(scope, pattern)`` fits a file's name or its path below the scope.

    A scope is a folder, '' the root. Patterns for folders (``x/`` and, if ``folders``, ``x/**`` alone) are told apart like in
    ``globs``; blank, malformed and null patterns fit nothing, a null path is not hidden. A path is expanded into the folders
    above it, which meet the scopes by equality; the root's patterns meet every path.
    """
    pattern = F.trim("pattern")
    if folders:
        base = F.when(pattern.endswith("/"), F.expr("left(trim(pattern), length(trim(pattern)) - 1)")).when(pattern.endswith("/**"), F.expr("left(trim(pattern), length(trim(pattern)) - 3)"))
    else:
        base = F.when(~pattern.endswith("/"), pattern)
    rules = scopes.where("scope is not null").select("scope", base.alias("base")).where("base != ''").distinct()
    rules = rules.select("scope", _regex(F.col("base")).alias("regex")).where("regex is not null")
    paths = rows.where(F.col(relative).isNotNull()).select(F.col(name).alias("name"), F.col(relative).alias("rel")).distinct()
    above = F.expr("transform(sequence(0, size(split(rel, '/')) - 1), k -> array_join(slice(split(rel, '/'), 1, k), '/'))")
    spread = paths.select("name", "rel", F.explode(above).alias("scope"))
    below = F.when(F.col("scope") == "", F.col("rel")).otherwise(F.substr("rel", F.length("scope") + 2))
    met = salted(spread.withColumn("below", below), rules, ["scope"], ["rel"], how="inner")
    found = met.where(F.expr("name rlike regex or below rlike regex")).select(F.col("name").alias("_name"), F.col("rel").alias("_rel")).distinct()
    on = F.col(name).eqNullSafe(F.col("_name")) & (F.col(relative) == F.col("_rel"))
    return rows.join(found, on, "left").select(*rows.columns, F.col("_rel").isNotNull().alias("hidden"))


def first_rules(rows: DataFrame, rules: DataFrame, status: str = "status", message: str = "message") -> DataFrame:
    """``rows`` with ``rule_order``: the smallest ``rule_order`` of ``rules(rule_order, status, pattern)`` whose status is the row's and
    whose pattern its message holds, whatever the case; null for none.

    Of a pattern the ``GRAM`` characters that the fewest patterns share are the key that messages meet it by; a shorter pattern
    meets every message of its status. Equal rows are judged once; a null message counts as empty.
    """
    rules = rules.where("pattern is not null and status is not null").select("rule_order", F.col("status").alias("of"), F.lower("pattern").alias("pattern")).distinct()
    grams = lambda text: F.expr(f"CASE WHEN length({text}) < {GRAM} THEN array('') ELSE array_distinct(transform(sequence(1, length({text}) - {GRAM - 1}), k -> substr({text}, k, {GRAM}))) END")
    patterns = rules.select("pattern").distinct().select("pattern", F.explode(grams("pattern")).alias("gram"))
    shared = patterns.groupBy("gram").agg(F.count("*").alias("n"))
    keys = patterns.join(shared, "gram").groupBy("pattern").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    keyed = rules.join(keys, "pattern")

    text = F.lower(F.coalesce(F.col(message), F.lit("")))
    kinds = rows.select(F.col(status).alias("of"), text.alias("text")).where("of is not null").groupBy("of", "text").agg(F.count("*").alias("n")).withColumn("kind", F.struct("of", "text"))
    parts = kinds.select("of", "text", F.explode(F.array_union(grams("text"), F.array(F.lit("")))).alias("gram"))
    met = salted(parts, keyed, ["of", "gram"], ["text"], how="inner").where(F.col("text").contains(F.col("pattern")))
    best = met.groupBy(F.struct("of", "text").alias("kind")).agg(F.min("rule_order").alias("rule_order"))
    known = kinds.select("kind", "n").join(best, "kind", "left")
    judged = with_known(rows.withColumn("kind", F.when(F.col(status).isNotNull(), F.struct(F.col(status).alias("of"), text.alias("text")))), known, "kind", rows.columns)
    return judged.select(*rows.columns, "rule_order")
