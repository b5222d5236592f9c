"""Toxicity: gradient-boosted trees over dense text features, with isotonic calibration.

Words are compared in a normal form: ASCII lower case, common digit-for-letter substitutions undone, everything that is
not a letter dropped, so ``L0ser!`` and ``lo*ser`` meet ``loser``. The lexicon holds common insults and the words and word
beginnings that the labelled sample ties to label 1, each with its log-odds. Features: lexicon densities (hits, strong
hits, weights, the densest 32 words), hits near a second-person word, capitals, exclamation, punctuation and
obfuscation rates, and length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import sample, scored
from .scratch import Scratch
from .textarrays import ASCII_LOWER, SPACE, Spans, Text, mix, texts

#: Bounds of the training sample: labelled rows of class 0 and 1.
SAMPLE = (7500, 2500)
#: Lengths of word beginnings in bytes; for a term, least texts of label 1 with it, label 1's least share of
#: all texts with it, and the log-likelihood by which that share must beat the sample's.
STEMS = (4, 5, 6, 7, 8, 9)
LEAST, PURITY, EVIDENCE = 3, 0.4, 9.0
#: Log-odds of common insults, and those from which a hit counts as strong.
GIVEN, STRONG = 4.0, 3.0
FOLDS = 4
NEAR, SPAN = 6, 32
#: Second-person words of the corpus's languages.
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos tú ti contigo usted ustedes vosotros vuestro"
#: Common insults that the lexicon holds from the start, for small sets of labels.
INSULTS = (
    "idiot moron stupid dumb loser scum trash garbage clown pathetic worthless disgusting fool jerk imbecile coward filth vermin degenerate "
    "dumm trottel abschaum versager widerlich feigling imbécile crétin abruti ordure minable estúpido imbécil basura asqueroso patético"
)
FEATURES = ("words", "hits", "strong_hits", "density", "weight", "mean_weight", "densest", "near_second_person", "second_person", "capitals", "exclamation", "punctuation", "obfuscation")

_LETTER = np.zeros(256, bool)
_LETTER[list(range(ord("a"), ord("z") + 1)) + list(range(0x80, 0x100))] = True
_NORMAL = ASCII_LOWER.copy()
for _a, _b in zip("013457@$", "oieastas", strict=True):
    _NORMAL[ord(_a)] = ord(_b)
_PLAIN = np.zeros(256, np.int32)
_PLAIN[[c for c in range(256) if chr(c).isascii() and chr(c).isalpha() or c >= 0x80]] = 1
_UPPER = np.zeros(256, np.int32)
_UPPER[ord("A") : ord("Z") + 1] = 1
_PUNCT = np.zeros(256, np.int32)
_PUNCT[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 1
_BANG = np.zeros(256, np.int32)
_BANG[ord("!")] = 1


def _hash_words(words: str) -> np.ndarray:
    text = next(texts(pa.array([words])))
    starts, ends, _ = text.words()
    return np.sort(text.span_hashes(starts, ends))


def normal_words(text: Text) -> tuple[Text, np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """The text in normal form, its words, and per word the hashes of the whole and of its beginnings (0: none)."""
    data = _NORMAL[text.data]
    keep = _LETTER[data] | SPACE[data]
    at = np.zeros(len(data) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    plain = Text(data[keep], at[text.offsets], text.first_row)
    starts, ends, rows = plain.words()
    if not len(starts):
        return plain, starts, ends, rows, [np.zeros(0, np.uint64)] * (1 + len(STEMS))
    spans = Spans(plain.data)
    out = [spans(starts, ends)]
    for n in STEMS:
        long = ends - starts > n
        out.append(np.where(long, mix(spans(starts, np.where(long, starts + n, ends)) + np.uint64(n)), np.uint64(0)))
    return plain, starts, ends, rows, out


class Lexicon:
    """Terms by hash with a weight each; the top 16 bits rule most words out before the search."""

    def __init__(self, terms: np.ndarray, weights: np.ndarray):
        order = np.argsort(terms)
        self.terms, self.weights = terms[order], weights[order]
        self.first = np.zeros(1 << 16, bool)
        self.first[(terms >> np.uint64(48)).astype(np.int64)] = True

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The weight of each key, 0 for others."""
        out = np.zeros(len(keys))
        if len(self.terms):
            at = np.flatnonzero(self.first[(keys >> np.uint64(48)).astype(np.int64)])
            place = np.searchsorted(self.terms, keys[at])
            place[place == len(self.terms)] = 0
            same = self.terms[place] == keys[at]
            out[at[same]] = self.weights[place[same]]
        return out


def features(text: Text, lexicon: Lexicon) -> np.ndarray:
    """One row of ``FEATURES`` per text; all zero for a text without words."""
    n = text.rows
    _, _, _, rows, keys = normal_words(text)
    raw_starts, raw_ends, raw_rows = text.words()
    total = np.bincount(raw_rows, minlength=n)
    size = np.maximum(total, 1)
    weight = lexicon.of(keys[0])
    for k in keys[1:]:
        np.maximum(weight, lexicon.of(k), out=weight)
    hit = weight > 0
    second = SECOND.of(keys[0]) > 0
    where = np.flatnonzero(hit)
    near = np.zeros(len(where), bool)
    densest = np.zeros(n)
    if len(where):
        sums = np.concatenate([[0], np.cumsum(second)])
        first = np.searchsorted(rows, np.arange(n + 1))
        low, high = np.maximum(where - NEAR, first[rows[where]]), np.minimum(where + NEAR + 1, first[rows[where] + 1])
        near = sums[high] > sums[low]
        sums = np.concatenate([[0], np.cumsum(hit)])
        np.maximum.at(densest, rows[where], sums[np.minimum(where + SPAN, first[rows[where] + 1])] - sums[where])
    lengths = np.maximum(np.diff(text.offsets), 1)

    def rate(table):
        sums = np.zeros(len(text.data) + 1, np.int64)
        np.cumsum(table[text.data], out=sums[1:])
        return (sums[text.offsets[1:]] - sums[text.offsets[:-1]]) / lengths, sums

    capitals, _ = rate(_UPPER)
    bangs, _ = rate(_BANG)
    punctuation, _ = rate(_PUNCT)
    _, letters = rate(_PLAIN)
    inside = raw_ends - raw_starts > 2
    a, b = raw_starts[inside], raw_ends[inside]
    edges = _PLAIN[text.data[a]].astype(bool) & _PLAIN[text.data[b - 1]].astype(bool)
    mixed = edges & (letters[b] - letters[a] < b - a)
    count = lambda flags, of: np.bincount(of[flags], minlength=n)
    hits, weighed = count(hit, rows), np.bincount(rows, weights=weight, minlength=n)
    return np.column_stack(
        [np.log1p(total), np.log1p(hits), np.log1p(count(weight >= STRONG, rows)), hits / size, np.log1p(weighed), weighed / size, densest, np.bincount(rows[where][near], minlength=n), count(second, rows) / size, capitals, bangs, punctuation, np.bincount(raw_rows[inside][mixed], minlength=n) / size]
    )


SECOND = Lexicon(_hash_words(SECOND_PERSON), np.ones(len(SECOND_PERSON.split())))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a chunk's texts in each fold and class hold each term; columns text, group."""
    for batch in batches:
        groups = batch.column(1).to_numpy(zero_copy_only=False)
        for text in texts(batch.column(0)):
            _, _, _, rows, keys = normal_words(text)
            own = groups[text.first_row : text.first_row + text.rows]
            parts = []
            for k in keys:
                full = np.flatnonzero(k)
                full = full[np.lexsort((rows[full], k[full]))]
                term, row = k[full], rows[full]
                first = np.ones(len(full), bool)
                first[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
                parts.append(np.stack([term[first], own[row[first]].astype(np.uint64)], 1))
            found, counts = np.unique(np.concatenate(parts), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, 0]).view(np.int64)), pa.array(found[:, 1].astype(np.int32)), pa.array(counts)], ["term", "group", "n"])


def lexicons(chosen: DataFrame) -> list[Lexicon]:
    """From the sample ``chosen(text, y, fold)``: for each fold the lexicon of the others, and last that of all.

    Spark counts and selects; the driver gets the selected terms only, each of which ``LEAST`` sampled texts of label 1 hold.
    """
    sizes = np.zeros((2, FOLDS))
    for r in chosen.groupBy("y", "fold").agg(F.count("*").alias("n")).collect():
        sizes[r["y"], r["fold"]] = r["n"]
    found = chosen.select("text", (F.col("y") * FOLDS + F.col("fold")).alias("group")).mapInArrow(_terms, "term bigint, group int, n bigint")
    counted = found.groupBy("term").agg(*(F.sum(F.when(F.col("group") == g, F.col("n")).otherwise(0)).alias(f"n{g}") for g in range(2 * FOLDS)))
    parts = [[g for g in range(FOLDS) if g != f] for f in range(FOLDS)] + [list(range(FOLDS))]
    terms, in_parts = [], []
    for part in parts:
        zeros, ones = (sum((F.col(f"n{y * FOLDS + f}") for f in part), F.lit(0)) for y in (0, 1))
        in_parts.append(_selected(ones, zeros, *sizes[:, part].sum(1).tolist()))
    for r in counted.select("term", F.array(*in_parts).alias("odds")).where(F.exists("odds", lambda x: x.isNotNull())).orderBy("term").collect():
        terms.append((r["term"], r["odds"]))
    keys, odds = np.array([t for t, _ in terms], np.int64).view(np.uint64), np.array([o for _, o in terms], float).reshape(len(terms), len(parts))
    return [_with_insults(keys[~np.isnan(o)], o[~np.isnan(o)]) for o in odds.T]


def _selected(ones: Column, zeros: Column, all_zeros: float, all_ones: float) -> Column:
    """Log-odds of a term that so many texts of either label hold, null if it doesn't tell them apart."""
    base = max(all_ones, 1e-9) / max(1.0, all_zeros + all_ones)
    share = ones / F.greatest(F.lit(1), ones + zeros)
    evidence = F.when(ones > 0, ones * F.ln(share / base)).otherwise(0.0) + F.when(zeros > 0, zeros * F.ln((1 - share) / max(1e-9, 1 - base))).otherwise(0.0)
    odds = F.greatest(F.lit(0.1), F.ln((ones + 0.5) / (zeros + 0.5) * ((all_zeros + 1) / (all_ones + 1))))
    return F.when((ones >= LEAST) & (share >= PURITY) & (share > base) & (evidence >= EVIDENCE), odds)


def _with_insults(keys: np.ndarray, odds: np.ndarray) -> Lexicon:
    weights = dict.fromkeys(_hash_words(INSULTS).tolist(), GIVEN) | dict(zip(keys.tolist(), odds.tolist(), strict=True))
    return Lexicon(np.array(list(weights), np.uint64), np.array(list(weights.values())))


class Forest:
    """Newton-boosted trees of fixed depth over quantile-binned features."""

    def __init__(self, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.base, self.nodes, self.cuts = 0.0, [], []

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Forest:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = self._bin(x)
        share = np.clip(np.average(y, weights=weight), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        f, width = np.full(len(y), self.base), self.bins + 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = weight * (p - y), weight * p * (1 - p)
            at, levels = np.zeros(len(y), int), []
            for depth in range(self.depth):
                nodes = 1 << depth
                best = np.full(nodes, -1.0)
                feature, cut = np.zeros(nodes, int), np.full(nodes, width)
                for j in range(x.shape[1]):
                    cell = at * width + binned[:, j]
                    gs, hs = (np.bincount(cell, weights=v, minlength=nodes * width).reshape(nodes, width).cumsum(1) for v in (g, h))
                    gr, hr = gs[:, -1:] - gs, hs[:, -1:] - hs
                    gain = gs**2 / (hs + self.ridge) + gr**2 / (hr + self.ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)
                    k = gain.argmax(1)
                    better = gain[np.arange(nodes), k] > best + 1e-9
                    best[better], feature[better], cut[better] = gain[np.arange(nodes), k][better], j, k[better]
                levels.append((feature, cut))
                at = at * 2 + (binned[np.arange(len(y)), feature[at]] > cut[at])
            leaves = 1 << self.depth
            value = -self.rate * np.bincount(at, weights=g, minlength=leaves) / (np.bincount(at, weights=h, minlength=leaves) + self.ridge)
            self.nodes.append((levels, value))
            f += value[at]
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)])

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        if not self.nodes or not len(x):
            return f
        binned, all_ = self._bin(x), np.arange(len(x))
        for levels, value in self.nodes:
            at = np.zeros(len(x), int)
            for feature, cut in levels:
                at = at * 2 + (binned[all_, feature[at]] > cut[at])
            f += value[at]
        return f


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots to interpolate between, never decreasing. Equal ``x`` are one point, their weighted mean."""
    points, of = np.unique(x, return_inverse=True)
    sums = np.bincount(of, weights=weight, minlength=len(points))
    means = np.bincount(of, weights=weight * y, minlength=len(points)) / sums
    blocks: list[list[float]] = []  # mean, weight, first x, last x
    for xi, yi, wi in zip(points, means, sums, strict=True):
        blocks.append([yi, wi, xi, xi])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m, w, _, last = blocks.pop()
            b = blocks[-1]
            b[0], b[1], b[3] = (b[0] * b[1] + m * w) / (b[1] + w), b[1] + w, last
    return np.array([v for b in blocks for v in (b[2], b[3])]), np.array([v for b in blocks for v in (b[0], b[0])])


class Model:
    def __init__(self, lexicon: Lexicon, forest: Forest, knots: tuple[np.ndarray, np.ndarray]):
        self.lexicon, self.forest, self.knots = lexicon, forest, knots

    def probability(self, text: Text) -> np.ndarray:
        if not self.forest.nodes:
            return np.full(text.rows, 0.5)
        return np.clip(np.interp(self.forest.margin(features(text, self.lexicon)), *self.knots), 0, 1)


def train(docs: DataFrame, labels: DataFrame, usable: Column, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: tuple[int, int] = SAMPLE) -> Model:
    """A model learnt from the bounded sample, which is written out once.

    Cross-fitting keeps it honest on little data: a row's features come from the lexicon of the other folds, and the
    calibration from forests that haven't seen the row. Where a class has no labelled rows the model gives 0.5.
    """
    chosen, totals = sample(docs, labels, label, usable, id_col, text_col, most)
    if min(totals.get(0, 0), totals.get(1, 0)) < 1:
        return Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0)), Forest(), (np.zeros(1), np.zeros(1)))
    scratch = Scratch(docs.sparkSession, "toxicity")
    chosen = scratch.table("sample", chosen.withColumn("fold", F.pmod(F.xxhash64("order"), F.lit(FOLDS)).cast("int")))
    known = lexicons(chosen)
    shared = docs.sparkSession.sparkContext.broadcast(known[:-1])

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folds = batch.column(3).to_numpy(zero_copy_only=False)
            for text in texts(batch.column(0)):
                own = folds[text.first_row : text.first_row + text.rows]
                got = np.zeros((text.rows, len(FEATURES)))
                for f, lexicon in enumerate(shared.value):
                    if (own == f).any():
                        got[own == f] = features(text, lexicon)[own == f]
                kept = [batch.column(k).slice(text.first_row, text.rows) for k in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(np.ascontiguousarray(c)) for c in got.T)], ["y", "order", "fold", *FEATURES])

    kind = "y int, order bigint, fold int, " + ", ".join(f"{c} double" for c in FEATURES)
    got = chosen.select("text", "y", "order", "fold").mapInArrow(dense, kind).toPandas().sort_values(["order", "y"], kind="stable")
    scratch.drop("sample")
    x, y, fold = got[list(FEATURES)].to_numpy(), got["y"].to_numpy(float), got["fold"].to_numpy()
    if not 0 < y.sum() < len(y):
        return Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0)), Forest(), (np.zeros(1), np.zeros(1)))
    weight = np.where(y == 1, totals[1] / y.sum(), totals[0] / (len(y) - y.sum()))
    weight *= len(y) / weight.sum()
    margin = np.zeros(len(y))
    for f in range(FOLDS):
        margin[fold == f] = Forest().fit(x[fold != f], y[fold != f], weight[fold != f]).margin(x[fold == f])
    return Model(known[-1], Forest().fit(x, y, weight), isotonic(margin, y, weight))


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """The columns of ``docs`` as the struct ``row`` (the text among them with ``keep_text``), with ``score`` for every whole text.

    A null text counts as empty; a text without words has no hits and gets the score that such texts have. Rows are scored one
    by one: repeated rows and null ids come out as they went in, equal texts with equal scores. Very long texts are read whole;
    an empty table gives an empty one; columns come back in ``row``, whatever their names.
    """
    return scored(docs, text_col, model, Model.probability, keep_text)
