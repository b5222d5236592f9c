"""Approximate nearest neighbours by largest inner product: query-aware collision counting.

A block of rows is projected on ``PROJECTIONS`` random directions, each of which is one sorted array. A query's window of
half-width ``WINDOW * R`` around its own projection holds the rows that collide with it. Virtual rehashing enlarges R: the
window's two edges move outward in the same arrays, and only the rows they pass are counted. Rows that collide
``threshold`` times are verified by their exact inner products, until the k-th best verified row lies within R: whatever
lies within R passes the threshold with probability ``PASS`` or more. Inner products become distances by one more
coordinate, sqrt(M^2 - |x|^2) with M the block's largest norm.

Rows are placed by the nearest of at most ``PIVOTS`` pivots, taken from the rows in the order of a hash: a bounded sample that
decides only where rows lie. Each pivot's rows are dealt over blocks of about ``ROWS``. A query first meets the block it
would lie in itself. Its k-th score there bounds what other blocks have to beat: by |x - c| <= r, no row of a pivot c with
radius r has a larger inner product than q.c + |q| r, so pivots below that bound are left out, without loss; in the other
blocks the bound is the one radius that has to be counted. A block's index is built once for ``QUERIES`` queries that
stream past it, so rows are copied once per that many queries and queries once per block that they must meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch

#: Rows of a block and bytes of its vectors; queries that one task streams past a block; queries counted at a time.
ROWS, BLOCK_BYTES, QUERIES, BATCH = 4096, 1 << 25, 1 << 16, 64
#: Most pivots, and most tasks of a search.
PIVOTS, TASKS = 256, 20000
PROJECTIONS, WINDOW, PASS = 32, 0.6, 0.97
GROWTH = 1.5
SEED = 7
_Z = {0.9: 1.2816, 0.95: 1.6449, 0.97: 1.8808, 0.99: 2.3263}


def threshold() -> int:
    """Collisions that a row at distance R reaches with probability ``PASS`` (normal approximation of the binomial)."""
    p = math.erf(WINDOW / math.sqrt(2))
    return max(1, math.floor(PROJECTIONS * p - _Z[PASS] * math.sqrt(PROJECTIONS * p * (1 - p))))


@lru_cache(8)
def _directions(size: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((size + 1, PROJECTIONS))


class Index:
    """Sorted projections of one block of rows of equal dimension; ``counted`` and ``verified`` tell the work of all searches."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        norms = np.einsum("ij,ij->i", vectors, vectors)
        self.top = float(norms.max())
        projected = np.column_stack([vectors, np.sqrt(np.maximum(self.top - norms, 0))]) @ _directions(vectors.shape[1])
        order = np.argsort(projected, axis=0, kind="stable")
        self.sorted = np.ascontiguousarray(np.take_along_axis(projected, order, 0).T)
        self.order = np.ascontiguousarray(order.T)
        self.some = vectors[np.random.default_rng(SEED).integers(0, len(vectors), 256)]
        self.counted = self.verified = 0

    def _start(self, queries: np.ndarray, lengths: np.ndarray, k: int) -> np.ndarray:
        """A first R for each query: half the distance within which k rows are expected, by a sample of the block."""
        square = lengths[:, None] + self.top - 2 * queries @ self.some.T
        return np.sqrt(np.maximum(np.quantile(square, min(1.0, k / len(self.ids)), axis=1), 0)) / 2

    def search(self, own: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its place, and the ids and exact scores of the k best rows found, the row ``own`` left out.

        With a finite bound only rows whose score reaches it are of interest.
        """
        for at in range(0, len(queries), BATCH):
            part = slice(at, at + BATCH)
            for i, ids, scores in self._batch(own[part], queries[part], bounds[part], k):
                yield at + i, ids, scores

    def _batch(self, own: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        least, n = threshold(), len(self.ids)
        centre = queries @ _directions(queries.shape[1])[:-1]
        lengths = np.einsum("ij,ij->i", queries, queries)
        smallest = 1e-6 * np.sqrt(lengths + self.top)
        slack = 1e-9 * np.sqrt(lengths * self.top)
        bounded = np.isfinite(bounds)
        radius = np.where(bounded, np.sqrt(np.maximum(lengths + self.top - 2 * np.where(bounded, bounds, 0), 0)), self._start(queries, lengths, k))
        radius = np.maximum(radius, smallest)
        low = np.stack([np.searchsorted(s, centre[:, p]) for p, s in enumerate(self.sorted)], 1)
        high = low.copy()
        counts, best = np.zeros((len(queries), n), np.int64), [(np.zeros(0, np.int64), np.zeros(0))] * len(queries)
        open_ = np.arange(len(queries))
        while len(open_):
            half = WINDOW * radius[open_] + smallest[open_] * 1e-3
            before_low, before_high = low[open_], high[open_]
            for p, s in enumerate(self.sorted):
                low[open_, p] = np.minimum(before_low[:, p], np.searchsorted(s, centre[open_, p] - half, "left"))
                high[open_, p] = np.maximum(before_high[:, p], np.searchsorted(s, centre[open_, p] + half, "right"))
            left = []
            for j, i in enumerate(open_):
                edges = zip(self.order, low[i].tolist(), before_low[j].tolist(), before_high[j].tolist(), high[i].tolist(), strict=True)
                passed = np.concatenate([part for o, a, b, c, d in edges for part in (o[a:b], o[c:d])])
                self.counted += len(passed)
                was = counts[i] >= least
                counts[i] += np.bincount(passed, minlength=n)
                new = np.flatnonzero((counts[i] >= least) & ~was)
                self.verified += len(new)
                new = self._reaching(new[self.rows[new] != own[i]], queries[i], max(bounds[i], best[i][1][-1] if len(best[i][1]) == k else -math.inf), k, slack[i])
                found = np.concatenate([best[i][0], new])
                scores = np.concatenate([best[i][1], (self.vectors[new] * queries[i]).sum(1)])
                if bounded[i]:
                    found, scores = found[scores >= bounds[i]], scores[scores >= bounds[i]]
                keep = np.lexsort((self.ids[found], -scores))[:k]
                best[i] = found[keep], scores[keep]
                reach = lengths[i] + self.top - 2 * best[i][1][-1] if len(keep) == k else math.inf
                if bounded[i] or reach <= radius[i] ** 2 or (high[i] - low[i]).min() == n:
                    yield int(i), self.ids[best[i][0]], best[i][1]
                    continue
                left.append(i)
                radius[i] = min(math.sqrt(max(reach, 0)) * (1 + 1e-9), GROWTH * radius[i]) if reach <= (GROWTH * radius[i]) ** 2 else GROWTH * radius[i]
            open_ = np.array(left, int)


    def _reaching(self, new: np.ndarray, query: np.ndarray, bound: float, k: int, slack: float) -> np.ndarray:
        """Those rows that can be among the k best and reach the bound: by a matrix product, whose last digits may be off."""
        near = self.vectors.take(new, 0) @ query
        if len(new) > k:
            bound = max(bound, np.partition(near, len(new) - k)[len(new) - k])
        return new[near >= bound - slack]


def usable(vector: Column) -> Column:
    """Not null, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of equal length as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _runs(*columns: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of rows that agree in all columns."""
    values = [c.to_numpy(zero_copy_only=False) for c in columns]
    if len(values[0]):
        edges = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1
        yield from zip([0, *edges.tolist()], [*edges.tolist(), len(values[0])], strict=True)


def _placed(rows: DataFrame, pivots: list[tuple[int, np.ndarray]]) -> DataFrame:
    """``rows(row, id, vector, asked, size)`` with the nearest pivot of equal size (-1: there is none) and the distance from it."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = {size: ([k for k, p in enumerate(shared.value) if len(p) == size], np.stack([p for p in shared.value if len(p) == size])) for size in {len(p) for p in shared.value}}
        for batch in batches:
            sizes = batch.column(4).to_numpy()
            cell, distance = np.full(len(sizes), -1), np.zeros(len(sizes))
            for size in set(sizes.tolist()) & set(centres):
                at, (names, centre) = np.flatnonzero(sizes == size), centres[size]
                x = _matrix(batch.column(2).take(pa.array(at)))
                near = ((centre * centre).sum(1) - 2 * x @ centre.T).argmin(1)
                cell[at], distance[at] = np.array(names)[near], np.sqrt(((x - centre[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(distance)], [*batch.schema.names, "cell", "distance"])

    return rows.mapInArrow(place, T.StructType([*rows.schema, T.StructField("cell", T.IntegerType()), T.StructField("distance", T.DoubleType())]))


def _open_cells(asked: DataFrame, pivots: list[np.ndarray], radii: dict[int, float]) -> DataFrame:
    """``asked(row, id, vector, size, bound)`` with ``cell``, once for each pivot whose rows could reach the bound."""
    shared = asked.sparkSession.sparkContext.broadcast((pivots, radii))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radii = shared.value
        for batch in batches:
            sizes, bounds = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            at, cells = [np.zeros(0, int)], [np.zeros(0, int)]
            for size in set(sizes.tolist()):
                own = np.flatnonzero(sizes == size)
                names = [k for k, p in enumerate(pivots) if len(p) == size]
                if not names:
                    at.append(own)
                    cells.append(np.full(len(own), -1))
                    continue
                names = np.array([k for k in names if k in radii])
                x, centre, radius = _matrix(batch.column(2).take(pa.array(own))), np.stack([pivots[k] for k in names]), np.array([radii[k] for k in names])
                reach = np.sqrt((x * x).sum(1))[:, None] * (radius + 1e-9 * (radius + np.sqrt((centre * centre).sum(1))))
                i, j = np.nonzero(x @ centre.T + reach >= bounds[own][:, None])
                at.append(own[i])
                cells.append(names[j])
            at = np.concatenate(at)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns), pa.array(np.concatenate(cells).astype(np.int32))], [*batch.schema.names, "cell"])

    return asked.mapInArrow(route, T.StructType([*asked.schema, T.StructField("cell", T.IntegerType())]))


def _found(index: DataFrame, routes: DataFrame, chunks: int, tasks: int, k: int) -> DataFrame:
    """``(row, query_id, vec_id, score)`` of ``routes(row, id, vector, bound, size, cell, part)`` in the blocks of ``index``."""
    place = ["size", "cell", "part", "chunk"]
    rows = index.select("size", "cell", "part", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(False).alias("asks"), "row", "id", "vector", F.lit(0.0).alias("bound"))
    asks = routes.select("size", "cell", "part", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk"), F.lit(True).alias("asks"), "row", "id", "vector", "bound")
    met = rows.union(asks).repartition(tasks, *place).sortWithinPartitions(*place, "asks")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts, built = None, [], None
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            for a, b in _runs(*(columns[c] for c in (*place, "asks"))):
                key = tuple(columns[c][a].as_py() for c in place)
                own, ids, vectors = columns["row"].slice(a, b - a).to_numpy(), columns["id"].slice(a, b - a).to_numpy(), _matrix(columns["vector"].slice(a, b - a))
                if key != block:
                    block, parts, built = key, [], None
                if not columns["asks"][a].as_py():
                    parts.append((own, ids, vectors))
                    continue
                if built is None and parts:
                    built, parts = Index(*(np.concatenate(x) for x in zip(*parts, strict=True))), []
                if built is not None:
                    bounds, out = columns["bound"].slice(a, b - a).to_numpy(), []
                    for i, near, scores in built.search(own, vectors, bounds, k):
                        out.append((np.full(len(near), own[i]), np.full(len(near), ids[i]), near, scores))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["row", "query_id", "vec_id", "score"])

    return met.mapInArrow(search, "row bigint, query_id bigint, vec_id bigint, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: up to k rows for each row that ``is_query`` (a condition on ``id``) selects.

    Ties go to the smaller id. A query's own row is no candidate, but other rows are, also those that repeat its id or vector; each
    row that asks gets its own result, so an id that asks twice has two. Rows with a null id or an unusable vector take no part,
    and vectors meet only those of their own size. Where a query has no other row it has no result. Other columns are ignored.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    element = vectors.schema[vector_col].dataType.elementType
    vector = vectors[vector_col] if isinstance(element, (T.FloatType, T.DoubleType)) else vectors[vector_col].cast("array<double>")
    rows = vectors.select(vectors[id_col].cast("bigint").alias("id"), vector.alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    sizes = rows.agg(F.count("*").alias("rows"), F.count_if(F.coalesce(is_query, F.lit(False))).alias("asked")).collect()[0]
    chosen = rows.orderBy(F.xxhash64("id", "vector"), "id").limit(min(PIVOTS, max(1, math.ceil(sizes["rows"] / ROWS)))).collect()
    pivots = [np.array(r["vector"], float) for r in chosen]
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "id", "vector", F.coalesce(is_query, F.lit(False)).alias("asked"), F.size("vector").alias("size"))
    placed = scratch.table("placed", _placed(numbered, pivots))

    most = F.greatest(F.lit(256), F.least(F.lit(ROWS), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("size")))))
    cells = scratch.table("cells", placed.groupBy("size", "cell").agg(F.max("distance").alias("radius"), F.ceil(F.count("*") / F.max(most)).alias("parts")))
    radii = {r["cell"]: r["radius"] for r in cells.where("cell >= 0").collect()}  # at most PIVOTS
    chunks = max(1, math.ceil(sizes["asked"] / QUERIES))
    blocks = cells.agg(F.coalesce(F.sum("parts"), F.lit(1)).alias("n")).collect()[0]["n"]
    tasks = min(TASKS, 2 * blocks * chunks)  # about a block each, unless there are very many
    parts = cells.select("size", "cell", "parts")
    index = scratch.table("index", placed.join(parts, ["size", "cell"]).withColumn("part", F.pmod(F.xxhash64("row"), "parts")).drop("distance", "parts"))
    scratch.drop("placed")

    asked = index.where("asked").select("row", "id", "vector", "size", "cell", "part")
    home = scratch.table("home", _found(index, asked.withColumn("bound", F.lit(float("-inf"))), chunks, tasks, k))
    bounds = home.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
    bounded = asked.join(bounds, "row", "left").select("row", "id", "vector", "size", F.coalesce("bound", F.lit(float("-inf"))).alias("bound"), F.struct("cell", "part").alias("home"))
    routes = _open_cells(bounded, pivots, radii).join(parts, ["size", "cell"])
    routes = routes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).where(F.struct("cell", "part") != F.col("home"))
    found = home.union(_found(index, routes, chunks, tasks, k))
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
