"""Near-duplicate documents: one-permutation MinHash with optimal densification, banded buckets, star-shaped candidates.

1. Every text becomes its set of 5-word shingle hashes. Texts with equal sets form a class; its smallest id stands for it.
2. A class's set is thrown once into ``BINS`` bins (the hash's top bits) and each bin keeps its smallest hash. An empty
   bin borrows from a bin that a random sequence, fixed per (bin, attempt), reaches first. ``BINS / ROWS`` bands of
   ``ROWS`` bins are the bucket keys: a pair at similarity 0.75 shares no bucket with probability (1 - .75^4)^32 = 5e-6.
3. Each bucket yields a star: its smallest member against all others, so candidates grow with members, not with pairs.
4. Candidates are verified on the full sets. Where the members of a bucket are still in several components, a sweep
   compares those outside its largest component with all other members, so no link between members of a bucket is
   lost. It goes through inverted indexes of about ``SWEEP`` shingles, past which the members stream, ``GROUP`` or as many as
   an index holds per task group. Of a member only its rarest quarter of shingles is looked up first: a linked set holds one of them, so
   members that share common passages alone cost no more than that. Pairs are counted, not emitted: at most one link per
   member and component comes out.

Texts are shipped, not shingle hashes: eight random bytes per word don't compress, words do. A centre with many candidates is dealt over several tasks, each of which holds the centre's set and streams the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.skew import salted

from .components import components
from .lines import WORD
from .scratch import Scratch
from .textarrays import ASCII_LOWER, Text, grams, mix, texts

SHINGLE = 5
LINKED, OF = 75, 100
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
ATTEMPTS = 1024
#: Members that are compared with a centre in one group; shingles that one group of the sweep indexes.
GROUP, SWEEP = 256, 1 << 20
#: Parts that a centre's candidates are dealt over while they learn how many there are.
SALTS = 64

_random = np.random.default_rng(20)
_BORROW = _random.integers(0, BINS, (ATTEMPTS, BINS))
_BAND = _random.integers(0, 1 << 63, (BINS,), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(text: Text) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each row, and their rows."""
    lower = ASCII_LOWER[text.data]
    starts, ends, rows = text.words()
    words = text.span_hashes(starts, ends, lower)
    hashes, at = grams(words, rows, SHINGLE)
    rows_of = rows[at]
    counts = np.bincount(rows, minlength=text.rows)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):  # the whole sequence is the one shingle
        first = np.searchsorted(rows, short)
        whole = np.array([grams(words[i : i + n], np.zeros(n, int), n)[0][0] for i, n in zip(first, counts[short], strict=True)], np.uint64)
        order = np.argsort(np.concatenate([rows_of, short]), kind="stable")
        hashes, rows_of = np.concatenate([hashes, whole])[order], np.concatenate([rows_of, short])[order]
    edges = np.searchsorted(rows_of, np.arange(text.rows + 1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        hashes[a:b].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (rows_of[1:] != rows_of[:-1])
    return hashes[keep], rows_of[keep]


def signatures(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Bins of each row's set; rows without shingles stay at the largest value and are not used."""
    bins = np.full((n, BINS), np.uint64(2**64 - 1))
    cell = rows * BINS + (hashes >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    bins.reshape(-1)[cell[first]] = hashes[first]
    full = np.zeros((n, BINS), bool)
    full.reshape(-1)[cell[first]] = True
    out = bins.copy()
    r, c = np.nonzero(~full & full.any(1)[:, None])
    for attempt in range(ATTEMPTS):
        if not len(r):
            break
        source = _BORROW[attempt, c]
        hit = full[r, source]
        out[r[hit], c[hit]] = bins[r[hit], source[hit]]
        r, c = r[~hit], c[~hit]
    for i, j in zip(r, c, strict=True):  # the next full bin, for the few sets that no attempt reached
        ahead = np.flatnonzero(full[i, (j + np.arange(BINS)) % BINS])[0]
        out[i, j] = bins[i, (j + ahead) % BINS]
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for text in texts(batch.column(1)):
            hashes, rows = shingle_sets(text)
            n = text.rows
            size = np.bincount(rows, minlength=n)
            edges = np.concatenate([[0], np.cumsum(size)])
            totals = []
            for salt in (0x51ED270B, 0x2545F491):
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes + np.uint64(salt)))])
                totals.append(sums[edges[1:]] - sums[edges[:-1]])
            keys = mix((signatures(hashes, rows, n) * _BAND).reshape(n, BANDS, ROWS).sum(2) + np.arange(BANDS, dtype=np.uint64))
            columns = [batch.column(0).slice(text.first_row, n), pa.array(size.astype(np.int64))]
            columns += [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (*totals, *keys.T)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_shingles", "set1", "set2", *(f"band{k}" for k in range(BANDS))])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by group with the centre's text first; a centre whose id has several texts has several sets."""
    group, centres = None, []
    for batch in batches:
        at = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        member, ids = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        found = []
        for text in texts(batch.column(4)):
            hashes, rows = shingle_sets(text)
            edges = np.searchsorted(rows, np.arange(text.rows + 1))
            for k in range(text.rows):
                own, i = hashes[edges[k] : edges[k + 1]], text.first_row + k
                if at[i] != group:
                    group, centres = at[i], []
                if not member[i]:
                    centres.append(own.copy())
                    continue
                for centre in centres:
                    place = np.searchsorted(centre, own)
                    place[place == len(centre)] = 0
                    both = int((centre[place] == own).sum()) if len(centre) else 0
                    if both and OF * both >= LINKED * (len(own) + len(centre) - both):
                        found.append((group[0], ids[i]))
                        break
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], batch.schema.field(0).type) for k in (0, 1)], ["a", "b"])


class _Sets:
    """Inverted index of some documents' sets: intersection sizes with all of them by one search per document."""

    def __init__(self, ids: list, roots: list, sets: list[np.ndarray]):
        self.ids, self.roots, self.sizes = ids, np.array(roots), np.array([len(x) for x in sets], np.int64)
        hashes = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.owner = np.repeat(np.arange(len(sets)), self.sizes)[order]
        self.keys, first = np.unique(hashes[order], return_index=True)
        self.edges = np.append(first, len(hashes))

    def linked(self, own: np.ndarray) -> np.ndarray:
        """Places of the indexed documents that ``own`` is linked with."""
        if not len(self.keys) or not len(own):
            return np.zeros(0, int)
        place = np.searchsorted(self.keys, own)
        place[place == len(self.keys)] = 0
        place = place[self.keys[place] == own]
        # A linked set lacks at most a quarter of the shingles of ``own``, so it holds one of any larger part of them.
        spare = len(own) - -(-LINKED * len(own) // OF)
        if len(own) - len(place) > spare:
            return np.zeros(0, int)
        rarest = place[np.argsort(self.edges[place + 1] - self.edges[place], kind="stable")[: spare + 1 - (len(own) - len(place))]]
        near = np.unique(self.owner[self._postings(rarest)])
        if not (np.minimum(self.sizes[near], len(own)) * OF >= np.maximum(self.sizes[near], len(own)) * LINKED).any():
            return np.zeros(0, int)
        both = np.bincount(self.owner[self._postings(place)], minlength=len(self.sizes))
        return np.flatnonzero((both > 0) & (OF * both >= LINKED * (len(own) + self.sizes - both)))

    def _postings(self, place: np.ndarray) -> np.ndarray:
        size = self.edges[place + 1] - self.edges[place]
        return np.repeat(self.edges[place] - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, part, member, id, root, text) come sorted by group, the sets to index before the members."""
    group, waiting, index, told = None, ([], [], []), None, set()
    for batch in batches:
        at = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        member, ids, roots = (batch.column(k).to_pylist() for k in (2, 3, 4))
        found = []
        for text in texts(batch.column(5)):
            hashes, rows = shingle_sets(text)
            edges = np.searchsorted(rows, np.arange(text.rows + 1))
            for k in range(text.rows):
                own, i = hashes[edges[k] : edges[k + 1]], text.first_row + k
                if at[i] != group:
                    group, waiting, index, told = at[i], ([], [], []), None, set()
                if not member[i]:
                    for kept, x in zip(waiting, (ids[i], roots[i], own.copy()), strict=True):
                        kept.append(x)
                    continue
                index = index or _Sets(*waiting)
                for j in index.linked(own):
                    bond = (roots[i], index.roots[j])
                    if bond[0] != bond[1] and bond not in told:
                        told.add(bond)
                        found.append((index.ids[j], ids[i]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], batch.schema.field(3).type) for k in (0, 1)], ["a", "b"])


def _links(scratch: Scratch, pairs: DataFrame, bodies: DataFrame, name: str) -> DataFrame:
    """Those of ``pairs(c, x)`` that the full sets confirm, as ``(a, b)``."""
    id_type = pairs.schema["c"].dataType
    sized = pairs.groupBy("c").agg(F.ceil(F.count("*") / GROUP).alias("groups")).where("groups > 1")
    dealt = salted(pairs, sized, ["c"], ["x"], SALTS).select("c", F.pmod(F.xxhash64("x"), F.coalesce("groups", F.lit(1))).alias("part"), "x")
    routes = dealt.select("c", "part", F.lit(True).alias("member"), F.col("x").alias("id"))
    routes = routes.union(dealt.select("c", "part").distinct().select("c", "part", F.lit(False), "c"))
    rows = routes.join(bodies, "id").select("c", "part", "member", "id", "text").repartition("c", "part").sortWithinPartitions("c", "part", "member")
    kind = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])
    return scratch.table(name, rows.mapInArrow(_verified, kind))


def _sweep(scratch: Scratch, members: DataFrame, labels: DataFrame, bodies: DataFrame) -> DataFrame:
    """Links between members of a bucket that are not connected yet; every member has met the bucket's centre already."""
    id_type = members.schema["rep"].dataType
    rest = members.where("rep != centre").select("bucket", "rep", "shingles")
    placed = rest.join(labels, rest["rep"] == labels["node"], "left").select("bucket", "rep", F.coalesce("root", "rep").alias("root"), "shingles")
    by_root = placed.groupBy("bucket", "root").agg(F.count("*").alias("n"), F.sum("shingles").alias("s"))
    largest = F.struct("n", "root")
    main = by_root.groupBy("bucket").agg(F.max_by("root", largest).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"), F.count("*").alias("roots"), (F.sum("s") - F.max_by("s", largest)).alias("open")).where("roots > 1")
    main = main.withColumn("parts", F.ceil(F.col("open") / SWEEP))
    # Members stream in blocks of at least as many as a part of the index has, so neither is copied more often than the other.
    main = main.select("bucket", "main", "parts", F.ceil(F.col("all") / F.greatest(F.lit(GROUP), (F.col("all") - F.col("most")) / F.col("parts"))).alias("blocks"))
    # Written like the shared buckets, so that a bucket with very many members can be split over tasks.
    placed = scratch.table("open", placed.join(scratch.table("mains", main), "bucket").select("bucket", "rep", "root", "main", "parts", "blocks"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    indexed = placed.where("root != main").select("bucket", F.pmod(F.xxhash64("rep"), "parts").alias("part"), every("blocks").alias("block"), F.lit(False).alias("member"), F.col("rep").alias("id"), "root")
    streamed = placed.select("bucket", every("parts").alias("part"), F.pmod(F.xxhash64("rep", F.lit(1)), "blocks").alias("block"), F.lit(True).alias("member"), F.col("rep").alias("id"), "root")
    cell = F.xxhash64("part", "block").alias("part")  # a bucket's sets to index by its members to stream, both in bounded parts
    routes = indexed.union(streamed).select("bucket", cell, "member", "id", "root")
    rows = routes.join(bodies, "id").select("bucket", "part", "member", "id", "root", "text").repartition("bucket", "part").sortWithinPartitions("bucket", "part", "member")
    return scratch.table("swept", rows.mapInArrow(_swept, T.StructType([T.StructField("a", id_type), T.StructField("b", id_type)])))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, n_shingles, component_id, kept)`` per row of ``docs``; every link has similarity 0.75 or more.

    A null, empty or word-less text has no shingles and is linked with nothing. Rows with a null id take no part: their
    component is null and they are kept. Very long texts are compared whole; an empty table gives an empty one. Rows that share an id are one node, linked by any of their texts, and share the
    decision. Other columns of ``docs`` are ignored, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    id_type = docs.schema["id"].dataType
    bands = [f"band{k}" for k in range(BANDS)]
    kind = T.StructType([T.StructField("id", id_type), *(T.StructField(c, T.LongType()) for c in ("n_shingles", "set1", "set2", *bands))])
    signed = scratch.table("signed", docs.mapInArrow(_signed, kind))

    classes = signed.where("n_shingles > 0 and id is not null").groupBy("set1", "set2").agg(F.min("id").alias("rep"), F.max("id").alias("last"), F.max("n_shingles").alias("shingles"), *(F.max(c).alias(c) for c in bands))
    classes = scratch.table("classes", classes)
    buckets = classes.select("rep", "shingles", F.explode(F.array(*bands)).alias("bucket"))
    # Written, so that the join meets a plain table and adaptive execution can split a bucket with very many members.
    shared = scratch.table("shared", buckets.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("last")).where("centre < last").select("bucket", "centre"))
    members = scratch.table("members", buckets.join(shared, "bucket").select("bucket", "rep", "shingles", "centre"))
    scratch.drop("shared")
    bodies = scratch.table("bodies", docs.join(members.select(F.col("rep").alias("id")).distinct(), "id", "left_semi"))

    # Ids with several sets tie the classes that these belong to.
    sets = F.struct("set1", "set2")
    several = scratch.table("several", signed.where("id is not null").groupBy("id").agg(F.min(sets).alias("least"), F.max(sets).alias("most")).where("least != most").select("id"))
    tied = bool(several.take(1))

    pairs = members.where("rep != centre").select(F.col("centre").alias("c"), F.col("rep").alias("x")).distinct()
    links = _links(scratch, pairs, bodies, "links0")
    if tied:
        held = signed.select("id", "set1", "set2").distinct().join(several, "id", "left_semi")
        links = links.union(scratch.table("ties", held.join(classes, ["set1", "set2"]).where("rep != id").select("rep", "id").distinct()))
    labels = components(scratch, links, "components0")
    extra = _sweep(scratch, members, labels, bodies)
    if extra.take(1):
        labels = components(scratch, links.union(extra), "components1")
    scratch.drop("members", "bodies")

    of_class = classes.join(labels, classes["rep"] == labels["node"], "left").where("rep != last or root is not null").select("set1", "set2", F.coalesce("root", "rep").alias("component"))
    by_class = signed.select("id", "n_shingles", "set1", "set2").join(of_class, ["set1", "set2"], "left")
    found = F.when(F.col("id").isNotNull() & (F.col("n_shingles") > 0), F.col("component"))
    if tied:  # a text without shingles goes with its id's other texts
        own = labels.join(several, labels["node"] == several["id"], "left_semi").select(F.col("node").alias("id"), F.col("root").alias("own"))
        by_class = by_class.join(own, "id", "left")
        found = F.coalesce(found, "own")
    component = F.coalesce(found, "id")
    return by_class.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


#: All pairs that share a shingle are counted, and every document follows its links to the end.
ORACLE_SQL = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
                                      ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM texts
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * pairs.n >= 75 * (x.n + y.n - pairs.n)
), edges AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reached r JOIN edges e ON r.other = e.a
), components AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT c.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept
FROM components c LEFT JOIN sizes s ON c.doc_id = s.doc_id
"""
