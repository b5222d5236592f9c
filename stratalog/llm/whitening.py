"""Whitening of embeddings from an exact integer scatter.

1. Entries become integers: x = floor(scale * c) + offset. The fit list holds each distinct x vector once.
2. Every task subtracts ``offset`` again and adds up the vectors and their cross-products exactly: entries are split into limbs
   of ``LIMB`` bits, so that products of a block of rows are integers that doubles hold, and the sums of limbs are put
   together as integers of any size. They leave the task as digits to base 2^32, which Spark adds up by (i, j).
3. n * X'X - S S' is formed of these integers (it doesn't depend on what was subtracted), and only then divided by n * n to
   doubles and decomposed by ``eigh``.

What reaches the driver is the sums, d * (d + 1) / 2 + d rows for d dimensions, however many vectors there are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Largest absolute integer before the offset; larger ones count as this.
BOUND = 1 << 61
#: Rows added up at a time; bits of a limb: ROWS * 2^(2 * LIMB) stays below 2^53.
ROWS, LIMB = 4096, 20
#: Digits of a sum to base 2^32: squares of 63 bits added up 2^60 times.
DIGITS = 6


def quantised(vector: Column, scale: int = SCALE, offset: int = OFFSET) -> Column:
    """Integers of a vector of floats or doubles; null if it is null, or holds nulls or non-finite entries."""
    usable = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))
    bounded = lambda c: F.greatest(F.least(F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(2.0**61)), F.lit(-(2.0**61)))), F.lit(BOUND)), F.lit(-BOUND))
    return F.when(usable, F.transform(vector, lambda c: (bounded(c) + F.lit(offset)).cast("bigint")))


@dataclass(frozen=True)
class Model:
    """``n`` fit vectors with sums ``total`` (of x less ``offset``); eigenvalues of all dimensions, falling, and their unit vectors as columns."""

    n: int
    offset: int
    total: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def axes(self, components: int) -> int:
        """How many of the first components have variance: an eigenvalue that rounding decides is none."""
        least = max(0.0, float(self.values[0])) * 2.0**-38 if len(self.values) else 0.0
        return int((self.values[:components] > least).sum())

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n in doubles; x holds integers less the offset."""
        whole = [divmod(t, self.n) for t in self.total]
        return (x - np.array([q for q, _ in whole], np.int64)).astype(np.float64) - np.array([r / self.n for _, r in whole])

    def project(self, x: np.ndarray, components: int) -> np.ndarray:
        k = self.axes(components)
        out = np.full((len(x), min(components, len(self.values))), np.nan)
        out[:, :k] = self.centred(x) @ (self.vectors[:, :k] / np.sqrt(self.values[:k]))
        return out

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n * x - S)^2 by row, exactly; None beyond 64 bits."""
        mean = [t // self.n for t in self.total]
        near = x - np.array(mean, np.int64)  # n * x - S = n * near - rest
        rest = np.array([t - self.n * m for t, m in zip(self.total, mean, strict=True)], object)
        largest = int(np.abs(near).max(initial=0)) * self.n + self.n
        if largest * largest * x.shape[1] < 1 << 63:
            return ((self.n * near - rest.astype(np.int64)) ** 2).sum(1).tolist()
        exact = ((near.astype(object) * self.n - rest) ** 2).sum(1).tolist()
        return [v if v < 1 << 63 else None for v in exact]


def scatter(x: np.ndarray) -> tuple[list[int], list[list[int]]]:
    """Exact column sums and cross-products of rows of 64-bit integers."""
    d = x.shape[1]
    total, product = np.zeros(d, object), np.zeros((d, d), object)
    for first in range(0, len(x), ROWS):
        rest, limbs = x[first : first + ROWS], []
        while True:  # x is the sum of limb_k * 2^(k * LIMB); the last limb carries the sign
            last = bool((np.abs(rest) < 1 << LIMB).all())
            limbs.append((rest if last else rest & ((1 << LIMB) - 1)).astype(np.float64))
            if last:
                break
            rest = rest >> LIMB
        whole = lambda a: a.astype(np.int64).astype(object)
        for i, a in enumerate(limbs):
            total += whole(a.sum(0)) << (i * LIMB)
            for j, b in enumerate(limbs):
                product += whole(a.T @ b) << ((i + j) * LIMB)
    return total.tolist(), product.tolist()


def _digits(value: int) -> list[int]:
    """Signed digits to base 2^32, lowest first."""
    sign, value = (-1, -value) if value < 0 else (1, value)
    return [sign * ((value >> (32 * k)) & 0xFFFFFFFF) for k in range(DIGITS - 1)] + [sign * (value >> (32 * (DIGITS - 1)))]


def _matrix(column: pa.Array) -> np.ndarray:
    rows = len(column)
    return column.flatten().to_numpy().reshape(rows, -1) if rows else np.zeros((0, 0), np.int64)


def fit(vectors: DataFrame, offset: int = OFFSET) -> Model | None:
    """The model of distinct ``vectors(x)``, arrays of equally many integers; None for no vectors.

    The eigenvectors are those of the covariance with divisor n.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, product = 0, None, None
        for batch in batches:
            if batch.num_rows:
                sums, products = scatter(_matrix(batch.column(0)) - offset)
                if total is None:
                    total, product = np.zeros(len(sums), object), np.zeros((len(sums), len(sums)), object)
                n, total, product = n + batch.num_rows, total + np.array(sums, object), product + np.array(products, object)
        if total is not None:
            d = len(total)
            entries = [(-1, -1, n), *((-1, i, total[i]) for i in range(d)), *((i, j, product[i, j]) for i in range(d) for j in range(i, d))]
            digits = np.array([_digits(int(v)) for _, _, v in entries], np.int64).T
            columns = [pa.array([e[k] for e in entries], pa.int32()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, digits)], ["i", "j", *(f"d{k}" for k in range(DIGITS))])

    digits = [f"d{k}" for k in range(DIGITS)]
    parts = vectors.select("x").mapInArrow(summed, "i int, j int, " + ", ".join(f"{c} bigint" for c in digits))
    rows = parts.groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in digits)).collect()  # bounded by the dimensions
    if not rows:
        return None
    exact = {(r["i"], r["j"]): sum(int(r[c]) << (32 * k) for k, c in enumerate(digits)) for r in rows}
    n = exact[-1, -1]
    d = sum(1 for i, j in exact if i < 0 <= j)
    total = [exact[-1, i] for i in range(d)]
    covariance = np.array([[(n * exact[min(i, j), max(i, j)] - total[i] * total[j]) / (n * n) for j in range(d)] for i in range(d)]).reshape(d, d)
    trace = sum(n * exact[i, i] - total[i] ** 2 for i in range(d)) / (n * n)
    values, axes = np.linalg.eigh(covariance)
    return Model(n, offset, total, values[::-1], axes[:, ::-1], trace)


def identity_error(vectors: DataFrame, model: Model, components: int = COMPONENTS) -> float:
    """Largest absolute entry of the whitened fit list's covariance less the identity; components without variance are left out.

    Two passes, both added up in Spark: the means, then the products of what is left after subtracting them.
    """
    k = model.axes(components)

    def sums(mean: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((k,) if mean is None else (k, k))
            for batch in batches:
                if batch.num_rows:
                    w = model.project(_matrix(batch.column(0)) - model.offset, components)[:, :k]
                    out += w.sum(0) if mean is None else (w - mean).T @ (w - mean)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(out.size)), pa.array(out.ravel())], ["at", "value"])

        rows = vectors.select("x").mapInArrow(run, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(k if mean is None else k * k)
        for r in rows:
            out[r["at"]] = r["value"]
        return out / model.n

    if not k:
        return 0.0
    return float(np.abs(sums(sums(None)).reshape(k, k) - np.eye(k)).max())


def whitened(docs: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET, keep: list[str] | None = None) -> DataFrame:
    """The usable rows of ``docs`` as the struct ``row`` (of the columns ``keep``, or all), with ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    ``whitened`` and ``explained`` are arrays with an entry for each of the first ``components`` components (or dimensions, if
    fewer). A component without variance has null as its whitened entries. Rows whose vector is null, empty or holds nulls or
    non-finite entries are dropped, and so are those of another length than most vectors have (of equally frequent lengths
    the largest counts). Entries beyond 2^61 after scaling count as 2^61; a deviation beyond 64 bits is null. Repeated rows
    come back as often as they come and weigh once; an empty table gives an empty one.
    """
    scratch = Scratch(docs.sparkSession, "whitening")
    rows = docs.select(F.struct(*(docs[c] for c in (docs.columns if keep is None else keep))).alias("row"), quantised(docs[vector_col], scale, offset).alias("x")).where("size(x) > 0")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    width = lengths[0]["d"] if lengths else 0
    rows = rows.where(F.size("x") == width)
    fit_list = scratch.table("fit", rows.select("x").distinct())
    model = fit(fit_list, offset)
    fields = [rows.schema["row"], T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()), *(T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("whitened", "explained")), T.StructField("identity_error", T.DoubleType())]
    if model is None:
        return docs.sparkSession.createDataFrame([], T.StructType(fields))
    error, share = identity_error(fit_list, model, components), model.values[: min(components, width)] / (model.trace or math.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = batch.num_rows
            if not count:
                continue
            x = _matrix(batch.column(1)) - offset
            edges = pa.array((np.arange(count + 1) * len(share)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edges, pa.array(v.ravel(), from_pandas=True)) for v in (model.project(x, components), np.tile(share, (count, 1)))]
            columns = [batch.column(0), pa.array(np.full(count, model.n)), pa.array(model.deviations(x), pa.int64()), *lists, pa.array(np.full(count, error))]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return rows.mapInArrow(run, T.StructType(fields))
