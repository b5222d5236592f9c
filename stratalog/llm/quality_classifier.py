"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-proximal updates.

A word yields two symbols: its bytes (ASCII lower-cased) and its shape (case, digits, non-ASCII letters, last character,
number of symbols, length, whether it repeats one of the two words before it and whether its 3-gram recurs in the text).
Features are 1-2-grams of words and 1-3-grams of shapes, hashed to ``DIMENSIONS`` slots, with value ``SCALE * count /
words``: a score is one sparse dot product. Training takes at most ``2 * PER_CLASS`` labelled rows, of which the driver holds
the distinct n-grams of the whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame

from .labelled import sample, scored
from .textarrays import ASCII_LOWER, Text, grams, mix, texts

DIMENSIONS = 1 << 18
SCALE = 8.0
#: Bound of the training sample: labelled rows of either class.
PER_CLASS = 2000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1

_CASES = [np.zeros(256, np.int32) for _ in range(5)]
for _k, _bytes in enumerate((range(ord("a"), ord("z") + 1), range(ord("A"), ord("Z") + 1), range(ord("0"), ord("9") + 1), range(0x80, 0x100))):
    _CASES[_k][list(_bytes)] = 1
_CASES[4][[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 1
_LAST = np.zeros(256, np.uint64)
for _k, _chars in enumerate((".", ",", "!", "?", ":;", "|", "#*$%&<>", "\"')]}", "0123456789", "-_=+/\\~^@`([{")):
    _LAST[[ord(c) for c in _chars]] = _k + 1


def occurrences(text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slot and row of every n-gram, and the number of words by row."""
    starts, ends, rows = text.words()
    counts = np.bincount(rows, minlength=text.rows)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), counts
    word = text.span_hashes(starts, ends, ASCII_LOWER[text.data])
    kinds = []
    for table in _CASES:
        sums = np.zeros(len(text.data) + 1, np.int32)
        np.cumsum(table[text.data], out=sums[1:])
        kinds.append(sums[ends] - sums[starts])
    shape = _LAST[text.data[ends - 1]]
    for k in kinds[:4]:
        shape = shape * np.uint64(2) + (k > 0)
    shape = shape * np.uint64(4) + np.minimum(kinds[4], 3).astype(np.uint64)
    shape = shape * np.uint64(4) + np.searchsorted([2, 5, 9], ends - starts, "right").astype(np.uint64)
    for back in (1, 2):
        same = np.zeros(len(word), np.uint64)
        same[back:] = (word[back:] == word[:-back]) & (rows[back:] == rows[:-back])
        shape = shape * np.uint64(2) + same
    again = np.zeros(len(word), np.uint64)
    triple, at = grams(word, rows, 3)
    _, inverse, times = np.unique(triple + rows[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_inverse=True, return_counts=True)
    again[at] = np.minimum(times[inverse] - 1, 3)
    shape = mix(shape * np.uint64(4) + again)
    slots, places = [], []
    for symbols, sizes in ((word, (1, 2)), (shape, (1, 2, 3))):
        for n in sizes:
            found, at = grams(symbols, rows, n)
            slots.append((found >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.int64))
            places.append(rows[at])
    return np.concatenate(slots), np.concatenate(places), counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each sampled text as its slots and values; columns text, y, order."""
    for batch in batches:
        for text in texts(batch.column(0)):
            slots, rows, counts = occurrences(text)
            keys, times = np.unique(rows * DIMENSIONS + slots, return_counts=True)
            edges = np.searchsorted(keys, np.arange(text.rows + 1) * DIMENSIONS)
            values = (SCALE * times / np.maximum(counts, 1)[keys // DIMENSIONS]).astype(np.float32)
            lists = [pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(x)) for x in ((keys % DIMENSIONS).astype(np.int32), values)]
            own = [batch.column(k).slice(text.first_row, text.rows) for k in (1, 2)]
            yield pa.RecordBatch.from_arrays([*own, *lists], ["y", "order", "slots", "values"])


def follow_leader(rows: list[tuple[int, float, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> np.ndarray:
    """FTRL-proximal over ``(y, weight, slots, values)``; the last of the returned weights is the bias."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rows = [(y, c, np.append(slots, DIMENSIONS), np.append(values, np.float32(1)).astype(float)) for y, c, slots, values in rows]
    for _ in range(epochs):
        for y, c, at, x in rows:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = c * (p - y) * x
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    return weights(np.arange(DIMENSIONS + 1)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> np.ndarray:
    """Weights learnt from the bounded sample; all zero where there are no labels."""
    chosen, _ = sample(docs, labels, label, usable, id_col, text_col, (per_class, per_class))
    kind = "y int, order bigint, slots array<int>, values array<float>"
    got = chosen.mapInArrow(_counted, kind).toArrow().combine_chunks()
    if not got.num_rows:
        return np.zeros(DIMENSIONS + 1, np.float32)
    y, order = got["y"].to_numpy(), got["order"].to_numpy()
    flat = [got[c].combine_chunks() if got[c].num_chunks != 1 else got[c].chunk(0) for c in ("slots", "values")]
    edges = np.concatenate([[0], np.cumsum(pc.list_value_length(flat[0]).to_numpy(zero_copy_only=False))])
    slots, values = (x.flatten().to_numpy(zero_copy_only=False) for x in flat)
    balance = {k: len(y) / (2 * max(1, int((y == k).sum()))) for k in (0, 1)}
    return follow_leader([(int(y[i]), balance[int(y[i])], slots[edges[i] : edges[i + 1]], values[edges[i] : edges[i + 1]]) for i in np.lexsort((y, order))])


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text as the struct ``row``, with ``score``: the probability of label 1 for every whole text.

    A null, empty or word-less text gets the bias's probability (0.5 for a model learnt from nothing). Rows are scored one by
    one: repeated rows and null ids come out as they went in, equal texts with equal scores. Very long texts are read whole; an
    empty table gives an empty one; columns come back in ``row``, whatever their names.
    """
    return scored(docs, text_col, weights, probability)


def probability(weights: np.ndarray, text: Text) -> np.ndarray:
    slots, rows, counts = occurrences(text)
    logit = weights[-1] + SCALE * np.bincount(rows, weights=weights[slots], minlength=text.rows) / np.maximum(counts, 1)
    return 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
