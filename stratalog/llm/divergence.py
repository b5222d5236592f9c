"""How sources of a language differ in their terms: counts behind a count-min sketch, then sparse joins of pairs.

1. Every task adds each document's distinct terms to a count-min sketch of document frequencies, ``DEPTH`` rows of ``WIDTH`` cells
   that stop at ``LEAST``. Sketches are cut into blocks that Spark deals by number, added up and stopped again: a cell never
   holds less than any of its terms' frequency, nor less than ``LEAST`` if that is reached.
2. Tasks read the merged sketch, whose size is fixed, and send on only terms whose every cell reaches ``LEAST``, as counts by
   (language, source, term) of some chunks of documents, dealt by (language, term). The exact frequencies then decide.
3. A pair's sum over all terms is split: as if a term were in one source only (by histograms of the sources' values), or in none
   (by number), and a correction for terms in both, by a join of the sparse values on (language, term). Both sides have a
   row per source and term at most, so no key is hot.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalog.skew import salted

from .scratch import Scratch
from .textarrays import ASCII_LOWER, Text, mix, texts

#: Documents that must hold a kept term; the sketch's size; cells that are merged together.
LEAST, WIDTH, DEPTH, BLOCK = 3, 1 << 20, 4, 1 << 16
#: Bytes of a chunk whose terms are counted together.
CHUNK = 1 << 21
#: Counts of chunks that a task holds at most before it adds them up and sends them on.
HELD = 1 << 19
#: Bytes past which a term is hashed on its own: running sums tell most long spans apart, but not those made to fool them.
LONG = 512
#: Unit of p, and the most terms that are listed per source.
UNIT, TOP = 1_000_000_000, 200
#: Parts that a source's or a language's rows are dealt over where they meet a row of its own.
SALTS = 64
_TERM = np.zeros(256, bool)
_TERM[ord("A") : ord("Z") + 1] = _TERM[ord("a") : ord("z") + 1] = _TERM[128:] = True
_ROWS = (np.arange(1, DEPTH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(-1, 1)


def terms(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, and starts, ends and rows of all terms: runs of ASCII letters and bytes beyond ASCII."""
    data = ASCII_LOWER[text.data]
    inside = _TERM[text.data]
    opens = np.empty(len(data) + 1, bool)
    opens[0] = opens[-1] = True
    opens[1:-1] = ~inside[:-1]
    opens[text.offsets] = True
    starts = np.flatnonzero(opens[:-1] & inside)
    opens[1:-1] = ~inside[1:]
    opens[text.offsets] = True
    ends = np.flatnonzero(opens[1:] & inside) + 1
    return data, starts, ends, np.searchsorted(text.offsets, starts, "right") - 1


def cells(keys: np.ndarray, width: int) -> np.ndarray:
    """The cell of each key in each row of the sketch."""
    return (mix(keys ^ _ROWS) >> np.uint64(64 - width.bit_length() + 1)).astype(np.int64)


def _hashed(names: pa.Array) -> np.ndarray:
    """A 64-bit hash per value, equal for equal strings; a null counts as empty."""
    out = np.zeros(len(names), np.uint64)
    for text in texts(names):
        out[text.first_row : text.first_row + text.rows] = text.span_hashes(text.offsets[:-1], text.offsets[1:])
    return out


def _keys(text: Text, langs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Bytes, starts, ends and rows of terms, and the key of each one's (language, term)."""
    data, starts, ends, rows = terms(text)
    hashes = text.span_hashes(starts, ends, data)
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        hashes[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]].tobytes(), digest_size=8).digest())
    return data, starts, ends, rows, mix(hashes ^ mix(langs[rows + text.first_row] + np.uint64(1)))


def _distinct(rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of the first of each (row, key); rows ascend."""
    order = np.argsort(keys, kind="stable")
    r, k = rows[order], keys[order]
    new = np.ones(len(order), bool)
    new[1:] = (r[1:] != r[:-1]) | (k[1:] != k[:-1])
    return order[new]


def _runs(groups: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal (group, key) stand together, otherwise as they came, and where each one's run begins."""
    order = np.argsort(mix(groups + keys), kind="stable")
    g, k = groups[order], keys[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    return order, new


def sketch(scratch: Scratch, docs: DataFrame, least: int = LEAST, width: int = WIDTH) -> DataFrame:
    """``(block, cells)`` of the merged sketch over ``docs(lang, source, text)``; blocks of zeros are left out."""
    block = min(BLOCK, width)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, added = np.zeros(DEPTH * width, np.uint8), np.zeros(width, np.int64)
        for batch in batches:
            langs = _hashed(batch.column(0))
            for text in texts(batch.column(2), CHUNK):
                _, _, _, rows, keys = _keys(text, langs)
                at = cells(keys[_distinct(rows, keys)], width)
                for k in range(DEPTH):
                    row = own[k * width : (k + 1) * width]
                    np.add.at(added, at[k], 1)
                    row[at[k]] = np.minimum(row[at[k]] + added[at[k]], least)  # only touched cells; repeats of one get the same value
                    added[at[k]] = 0
        yield from _blocks(own.reshape(-1, block))

    def _blocks(own: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k in np.flatnonzero(own.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([own[k].tobytes()], pa.binary())], ["block", "cells"])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # a block at a time, as rows come sorted
        for batch in batches:
            for k, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k not in held:
                    for done, old in held.items():
                        yield pa.RecordBatch.from_arrays([pa.array([done]), pa.array([old.tobytes()], pa.binary())], ["block", "cells"])
                    held = {k: np.zeros(block, np.uint8)}
                held[k] = np.minimum(held[k] + np.frombuffer(part.as_buffer(), np.uint8), least).astype(np.uint8)
        for done, old in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([done]), pa.array([old.tobytes()], pa.binary())], ["block", "cells"])

    kind = "block bigint, cells binary"
    # Two levels: a block's parts are first added up by the task that made them, so that none meets all tasks' parts at once.
    parts = docs.select("lang", "source", "text").mapInArrow(counted, kind).withColumn("part", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    first = parts.repartition("block", "part").sortWithinPartitions("block", "part").select("block", "cells").mapInArrow(merged, kind)
    return scratch.table("sketch", first.repartition("block").sortWithinPartitions("block").mapInArrow(merged, kind))


def counts(scratch: Scratch, docs: DataFrame, least: int = LEAST, width: int = WIDTH) -> DataFrame:
    """``(lang, source, term, count, in_lang, first)`` of all kept terms: occurrences in the source and in the language, and whether the
    source is the first of the language's that hold the term, so that one row per (language, term) is marked."""
    spark, block = docs.sparkSession, min(BLOCK, width)
    table = np.zeros((DEPTH * width // block, block), np.uint8)
    for r in sketch(scratch, docs, least, width).toLocalIterator():  # of fixed size
        table[r["block"]] = np.frombuffer(r["cells"], np.uint8)
    enough = spark.sparkContext.broadcast(np.packbits(table.reshape(-1) >= least))

    def added_up(held: list[tuple]) -> pa.RecordBatch:
        *numbers, langs, sources, words = zip(*held, strict=True)
        group, keys, n, n_docs = map(np.concatenate, numbers)
        order, new = _runs(group, keys)
        first = np.flatnonzero(new)
        named = [pa.concat_arrays(x).take(pa.array(order[first])) for x in (langs, sources, words)]
        return pa.RecordBatch.from_arrays([*named, *(pa.array(np.add.reduceat(x[order], first)) for x in (n, n_docs))], ["lang", "source", "term", "count", "docs"])

    def surviving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(enough.value).astype(bool)
        held: list[tuple] = []
        for batch in batches:
            langs, sources = _hashed(batch.column(0)), _hashed(batch.column(1))
            groups = mix(mix(langs + np.uint64(1)) + sources)
            for text in texts(batch.column(2), CHUNK):
                data, starts, ends, rows, keys = _keys(text, langs)
                at = cells(keys, width)
                keep = np.logical_and.reduce([bits[k * width + at[k]] for k in range(DEPTH)])
                starts, ends, rows, keys = starts[keep], ends[keep], rows[keep], keys[keep]
                if not len(keys):
                    continue
                group = groups[rows + text.first_row]
                order, new = _runs(group, keys)
                r = rows[order]  # ascending in each run
                of_doc = new.copy()
                of_doc[1:] |= r[1:] != r[:-1]
                first = np.flatnonzero(new)
                n, n_docs = np.diff(np.append(first, len(order))), np.add.reduceat(of_doc.astype(np.int64), first)
                place = order[first]
                size = ends[place] - starts[place]
                edges = np.concatenate([[0], np.cumsum(size)])
                body = data[np.repeat(starts[place] - edges[:-1], size) + np.arange(edges[-1])]
                words = pa.StringArray.from_buffers(len(place), pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(body))
                row = pa.array(rows[place] + text.first_row)
                held.append((group[place], keys[place], n, n_docs, batch.column(0).take(row), batch.column(1).take(row), words))
                if sum(len(x[0]) for x in held) >= HELD:
                    yield added_up(held)
                    held = []
        if held:
            yield added_up(held)

    found = docs.select("lang", "source", "text").mapInArrow(surviving, "lang string, source string, term string, count bigint, docs bigint")
    # One shuffle, by term, serves the counts of sources and of the language: a task sends a source's term once or a few times.
    exact = found.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("term", "lang")  # rows are sorted by the first, which tells them apart
    all_docs, in_lang, first = F.sum("docs").over(of_term), F.sum("count").over(of_term), F.col("source") == F.min("source").over(of_term)
    known = exact.select("lang", "source", "term", "count", all_docs.alias("all"), in_lang.alias("in_lang"), first.alias("first"))
    return scratch.table("kept", known.where(F.col("all") >= least).drop("all"))


def _p(count: str, total: str, terms_: str) -> Column:
    """p = 1 + floor(UNIT * (count + 1) / (total + V)) of exact integers; decimals, which are slow, where 64 bits don't hold the product."""
    wide = f"(CAST({UNIT} AS DECIMAL(10,0)) * CAST({count} + 1 AS DECIMAL(20,0))) div CAST({total} + {terms_} AS DECIMAL(20,0))"
    return F.expr(f"1 + CASE WHEN {count} < {(1 << 63) // UNIT - 1} THEN ({UNIT}L * ({count} + 1)) div ({total} + {terms_}) ELSE {wide} END")


def _f(p: str, q: str) -> str:
    """floor((p - q)^2 / q), as SQL."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) div ({q}))"


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least: int = LEAST, top: int = TOP, width: int = WIDTH) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: how every source differs from the others of its language, and by which terms.

    Null languages, sources and texts count as ''. Part ``pair``: ``item`` is another source, ``value`` the sum over the language's
    kept terms of (p - q)^2 / q in whole numbers, 0 if it keeps none. Part ``term``: ``item`` is a term that the source holds more
    of than its language, and its value, the first ``top`` of them. Of equal values the item that is first by its bytes ranks
    first. A text without terms counts for nothing but its source, which has a row per other source all the same; repeated
    rows are documents of their own; very long texts are read whole; other columns are ignored, whatever their names. An
    empty table gives an empty one, and so do the pairs of a language's only source.
    """
    scratch = Scratch(docs.sparkSession, "divergence")
    blank = lambda c: F.coalesce(docs[c].cast("string"), F.lit(""))
    docs = docs.select(blank(lang_col).alias("lang"), blank(source_col).alias("source"), docs[text_col].alias("text"))
    kept = counts(scratch, docs, least, width)

    held = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"), F.count("*").alias("m"), F.count_if("first").alias("n_first"))
    sizes = held.groupBy("lang").agg(F.sum("n_first").alias("v"), F.sum("n").alias("n_lang"))
    groups = docs.select("lang", "source").distinct().join(held, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n", "m", "v", "n_lang")))
    groups = scratch.table("groups", groups.withColumn("p0", F.when(F.col("v") > 0, _p("0", "n", "v"))))

    in_source = salted(kept.select("lang", "source", "term", "count", "in_lang"), groups, ["lang", "source"], ["term"], SALTS, "inner")
    in_source = scratch.table("shares", in_source.select("lang", "source", "term", "p0", _p("count", "n", "v").alias("p"), _p("in_lang", "n_lang", "v").alias("q")))

    a, b = (groups.select("lang", F.col("source").alias(f"source_{x}"), F.col("p0").alias(f"p0_{x}"), F.col("m").alias(f"m_{x}"), *(["v"] if x == "a" else [])) for x in "ab")
    pairs = scratch.table("pairs", salted(a, b, ["lang"], ["source_a"], SALTS, "inner").where("source_a != source_b"))  # as many rows as the result has
    histogram = scratch.table("histogram", in_source.groupBy("lang", "source", "p").agg(F.count("*").alias("k")))
    others = groups.where("v > 0").select("lang", F.col("source").alias("other"), F.col("p0").alias("q"))
    alone = salted(histogram.select("lang", "source", "p", "k"), others, ["lang"], ["source", "p"], SALTS, "inner").where("source != other")
    alone = alone.groupBy("lang", "source", "other").agg(F.expr(f"sum(k * {_f('p', 'q')})").alias("up"), F.expr(f"sum(k * {_f('q', 'p')})").alias("down"))
    left, right = (in_source.select("lang", "term", F.col("source").alias(f"source_{x}"), F.col("p").alias(f"p_{x}"), F.col("p0").alias(f"p0_{x}")) for x in "ab")
    both = left.join(right, ["term", "lang"]).where("source_a < source_b")  # each pair once, for both directions
    change = lambda a, b: f"sum({_f(f'p_{a}', f'p_{b}')} - {_f(f'p_{a}', f'p0_{b}')} - {_f(f'p0_{a}', f'p_{b}')} + {_f(f'p0_{a}', f'p0_{b}')})"
    both = both.groupBy("lang", "source_a", "source_b").agg(F.expr(change("a", "b")).alias("ab"), F.expr(change("b", "a")).alias("ba"))
    both = both.selectExpr("lang", "stack(2, source_a, source_b, ab, source_b, source_a, ba) AS (source_a, source_b, both)")
    ups = alone.select("lang", F.col("source").alias("source_a"), F.col("other").alias("source_b"), "up")
    downs = alone.select("lang", F.col("other").alias("source_a"), F.col("source").alias("source_b"), "down")
    keys = ["lang", "source_a", "source_b"]
    summed = pairs.join(ups, keys, "left").join(downs, keys, "left").join(both, keys, "left")
    value = F.expr(f"coalesce(up, 0) + coalesce(down, 0) + coalesce(both, 0) + CASE WHEN v > 0 THEN (v - m_a - m_b) * {_f('p0_a', 'p0_b')} ELSE 0 END")
    by_pair = summed.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), value.cast("bigint").alias("value"))

    by_term = in_source.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_f("p", "q")).alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    return ranked(by_pair).unionByName(ranked(by_term).where(F.col("rank") <= top))


#: Every pair and term is computed densely, in integers of 128 bits.
ORACLE_SQL = f"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), words AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS c FROM words GROUP BY lang, term HAVING count(DISTINCT d) >= {LEAST}
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(c)::HUGEINT AS n FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), cells AS (
  SELECT g.lang, g.source, k.term, k.c AS in_lang, coalesce(x.c, 0)::HUGEINT AS c
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN (SELECT lang, source, term, count(*) AS c FROM words GROUP BY ALL) x
    ON x.lang = g.lang AND x.source = g.source AND x.term = k.term
), totals AS (
  SELECT lang, source, sum(c)::HUGEINT AS n FROM cells GROUP BY lang, source
), p AS (
  SELECT e.lang, e.source, e.term, e.c, 1 + ({UNIT}::HUGEINT * (e.c + 1)) // (t.n + l.v) AS p, 1 + ({UNIT}::HUGEINT * (e.in_lang + 1)) // (l.n + l.v) AS q
  FROM cells e JOIN totals t ON t.lang = e.lang AND t.source = e.source JOIN langs l ON l.lang = e.lang
), pairs AS (
  SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), summed AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows_ AS (
  SELECT x.lang, x.source, 'pair' AS part, x.item, coalesce(s.value, 0)::BIGINT AS value
  FROM pairs x LEFT JOIN summed s ON s.lang = x.lang AND s.source = x.source AND s.item = x.item
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE c > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM rows_
)
SELECT lang, source, part, item, value, r::INT AS rank FROM ranked WHERE part = 'pair' OR r <= {TOP}
"""
