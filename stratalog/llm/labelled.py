"""What the classifiers share: the bounded sample of labelled rows they learn from, and scoring whole tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textarrays import Text, texts


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, id_col: str, text_col: str, most: tuple[int, int]) -> tuple[DataFrame, dict[int, int]]:
    """``(text, y, order)``: one row for each of at most ``most[y]`` labelled ids of class y; and how many ids each class has.

    ``usable`` is a condition on the labels' ``id``. Ids come in the order of a hash, so the sample doesn't follow the
    storage; ids with a null or contradictory label are left out. The chosen ids number at most ``sum(most)``, which is
    what makes broadcasting them safe; of an id's several texts the one with the smallest hash is taken, a null one last.
    """
    clean = labels.select(labels[id_col].alias("id"), labels[label].cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isin(0, 1) & usable)
    clean = clean.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("y1")).where("y = y1").select("id", "y", F.xxhash64("id").alias("order"))
    totals = {r["y"]: r["n"] for r in clean.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = clean.where(F.col("y") == y).orderBy("order", "id").limit(most[y])
        chosen = part if chosen is None else chosen.union(part)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "id")
    one = F.min(F.struct(F.col("text").isNull(), F.xxhash64("text"), "text")).alias("one")
    return rows.groupBy("id", "y", "order").agg(one).select("one.text", "y", "order"), totals


def scored(docs: DataFrame, text_col: str, model: Any, probability: Callable[[Any, Text], np.ndarray], keep_text: bool = False) -> DataFrame:
    """``docs`` as the struct ``row`` (without the text unless ``keep_text``) and ``score``, so no name can clash."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if keep_text or c != text_col]
    rows = docs.select(F.struct(*(docs[c] for c in kept)).alias("row"), *([] if keep_text else [docs[text_col].alias("text")]))
    at = kept.index(text_col) if keep_text else None

    def with_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1) if at is None else batch.column(0).field(at)
            out = [probability(shared.value, text) for text in texts(column)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], ["row", "score"])

    return rows.mapInArrow(with_scores, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))
