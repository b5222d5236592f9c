"""Packing into sequences of at most 1024 tokens, in order, by dynamic programming over cut positions.

Candidate cuts are document ends and sentence ends: line ends, and ``. ! ?`` (closing quotes and brackets after them included)
before a blank. Only where a stretch of more than ``LENGTH`` tokens has neither, every ``STRETCH``-th of its tokens is one. With p the positions of the cuts, f(j) = penalty(j) + min over i of
f(i) + padding(p_j - p_i), where the window may hold ``LENGTH`` tokens at most. Padding is ``LENGTH - (p_j - p_i)``, so the
minimum is a sliding minimum of f(i) + p_i, which a monotone queue gives in constant time per cut; a window whose length
is a power of two has no padding, and those few transitions are looked up by position.

The stream is cut into blocks of about ``BLOCK`` tokens at document ends, so memory is bounded by a block or one document.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textarrays import texts
from .tokens import encoder, ids_of, token_bytes

LENGTH = 1024
BLOCK = 1 << 18
END = 0
#: What a cut costs, in tokens of padding: at a document's end, at a sentence's, elsewhere.
AT_DOCUMENT, AT_SENTENCE, ELSEWHERE = 0.0, 1.0, 6.0
#: Likewise for every sequence, so that the many exact powers of two do not lead to a swarm of tiny ones.
OPEN = 8.0
STRETCH = 32
_POWERS = [1 << k for k in range(LENGTH.bit_length())]


def token_kinds(vocabulary: str | None = None) -> np.ndarray:
    """By id, whether the token ends a line (1) or may end a sentence (2), and whether it begins with a blank (4)."""
    out = []
    for token in token_bytes(vocabulary):
        closes = token.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?")
        out.append((token[-1:] == b"\n") + 2 * closes + 4 * (token[:1] in (b" ", b"\t", b"\n", b"\r")))
    return np.array(out, np.uint8)


def candidates(ids: np.ndarray, doc_ends: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a sequence may end, ascending from 0, and each one's penalty."""
    cost = np.full(len(ids) + 1, -1.0)
    of = kinds[ids]
    cost[np.flatnonzero(of & 1) + 1] = AT_SENTENCE
    cost[np.flatnonzero((of[:-1] & 2 > 0) & (of[1:] & 4 > 0)) + 1] = AT_SENTENCE
    cost[doc_ends] = AT_DOCUMENT
    cost[0] = 0.0
    fixed = np.flatnonzero(cost >= 0)
    gaps = np.diff(fixed)
    wide = np.flatnonzero(gaps > LENGTH)
    for a, n in zip(fixed[wide], gaps[wide], strict=True):
        cost[a + STRETCH : a + n : STRETCH] = ELSEWHERE
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_cuts(at: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Indexes of the chosen cuts, without the first position, with the least total of padding and penalties.

    Of equal choices the one with the earliest start is taken; gaps between candidates are at most ``LENGTH``.
    """
    n = len(at)
    place = np.full(int(at[-1]) + 1, -1, np.int64)
    place[at] = np.arange(n)
    exact_j, exact_i = [], []
    for power in _POWERS:
        back = at - power
        ok = np.flatnonzero(back >= 0)
        found = place[back[ok]]
        exact_j.append(ok[found >= 0])
        exact_i.append(found[found >= 0])
    exact_j, exact_i = np.concatenate(exact_j), np.concatenate(exact_i)
    order = np.lexsort((exact_i, exact_j))
    exact_i = exact_i[order].tolist()
    edges = np.searchsorted(exact_j[order], np.arange(n + 1)).tolist()
    p, c = at.tolist(), cost.tolist()
    f, came = [0.0] * n, [0] * n
    queue: deque = deque([(0.0, 0, 0)])  # f(i) + p_i, p_i, i, with ascending values
    for j in range(1, n):
        pj = p[j]
        while queue[0][1] < pj - LENGTH:
            queue.popleft()
        value, _, i = queue[0]
        value += LENGTH - pj
        for k in exact_i[edges[j] : edges[j + 1]]:
            if f[k] < value:
                value, i = f[k], k
        value += c[j] + OPEN
        f[j], came[j] = value, i
        value += pj
        while queue and queue[-1][0] > value:
            queue.pop()
        queue.append((value, pj, j))
    out, j = [], n - 1
    while j:
        out.append(j)
        j = came[j]
    return np.array(out[::-1], np.int64)


def pack_block(ids: np.ndarray, doc_edges: np.ndarray, kinds: np.ndarray, first_sequence: int) -> tuple[dict[str, np.ndarray], int]:
    """Pieces of a block of documents: each lies in one document and one sequence. Also the next free sequence number."""
    at, cost = candidates(ids, doc_edges[1:], kinds)
    cuts = at[best_cuts(at, cost)]
    starts = np.unique(np.concatenate([[0], cuts, doc_edges]))
    starts = starts[starts < len(ids)]
    ends = np.append(starts[1:], len(ids))
    doc = np.searchsorted(doc_edges, starts, "right") - 1
    sequence = np.searchsorted(cuts, starts, "right")
    opens = np.concatenate([[0], cuts])[sequence]
    little = ids.astype("<u4").tobytes()
    crc = np.array([zlib.crc32(little[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
    sizes = np.diff(doc_edges)
    out = {"doc": doc, "start": starts - doc_edges[doc], "length": ends - starts, "ids_crc32": crc, "doc_tokens": sizes[doc], "sequence_id": first_sequence + sequence, "offset": starts - opens}
    return out, first_sequence + len(cuts)


PIECES = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, order: list[Column], id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """``(id_col, *PIECES)``, one row per piece, and the piece's ``ids`` with ``with_ids``.

    Documents are packed in the order of ``order``, then of their texts' hashes: the rows are range-partitioned by both, and
    each partition numbers its sequences from its own range. Null and repeated ids are therefore spread by their texts;
    rows that are equal in order and text lie together, in one partition. A null or empty text is the single id 0. Repeated
    rows are packed as often as they come; very long texts are packed whole; an empty table gives an empty one; other columns
    of ``docs`` are ignored, whatever their names. ``sequence_id`` and the cuts follow the number of partitions and so may
    differ from run to run; every piece's place in its document and its ids don't depend on them.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), *(c.alias(f"by{k}") for k, c in enumerate(order)))
    keys = [f"by{k}" for k in range(len(order))]
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(*keys, "tie").sortWithinPartitions(*keys, "tie").select("id", "text")
    fields = [T.StructField(id_col, rows.schema["id"].dataType), *(T.StructField(c, T.LongType()) for c in PIECES)]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kinds = encoder(vocabulary), token_kinds(vocabulary)
        sequence, held = TaskContext.get().partitionId() << 32, []

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held
            ids = np.concatenate([x for _, x in held])
            edges = np.concatenate([[0], np.cumsum([len(x) for _, x in held])])
            out, sequence = pack_block(ids, edges, kinds, sequence)
            names = pa.concat_arrays([x for x, _ in held]).take(pa.array(out["doc"]))
            columns = [names, *(pa.array(out[c].astype(np.int64)) for c in PIECES)]
            if with_ids:
                cut = np.append(out["start"] + edges[out["doc"]], len(ids)).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(cut), pa.array(ids.astype(np.int32))))
            held = []
            return pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

        size = 0
        for batch in batches:
            for text in texts(batch.column(1)):
                ids, edges = ids_of(text, encode)
                names = batch.column(0).slice(text.first_row, text.rows)
                for k in range(text.rows):
                    held.append((names.slice(k, 1), np.append(ids[edges[k] : edges[k + 1]], END)))
                    size += len(held[-1][1])
                    if size >= BLOCK:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return rows.mapInArrow(packed, T.StructType(fields))
