"""Parts of the classifiers against plain loops."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from stratalog.llm import quality_classifier, textarrays, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Classes of a word's last character, as the classifier has them.
LAST = (".", ",", "!", "?", ":;", "|", "#*$%&<>", "\"')]}", "0123456789", "-_=+/\\~^@`([{")


def shapes(text):
    """Each word's shape as a tuple."""
    words = [w.encode() for w in WORD.findall(text)]
    lower = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words]
    triples = [tuple(lower[k : k + 3]) for k in range(len(words) - 2)]
    out = []
    for k, w in enumerate(words):
        marks = sum(0x21 <= b < 0x7F and not chr(b).isalnum() for b in w)
        kinds = (any(97 <= b <= 122 for b in w), any(65 <= b <= 90 for b in w), any(48 <= b <= 57 for b in w), any(b >= 128 for b in w))
        last = next((n + 1 for n, chars in enumerate(LAST) if chr(w[-1]) in chars), 0)
        length = sum(len(w) >= n for n in (2, 5, 9))
        same = tuple(k >= back and lower[k] == lower[k - back] for back in (1, 2))
        again = min(triples.count(triples[k]) - 1, 3) if k < len(triples) else 0
        out.append((last, *kinds, min(marks, 3), length, *same, again))
    return out


def test_shape_ngrams_against_plain_tuples():
    """Slots of shape 1- to 3-grams are equal where the tuples are, and nearly all others differ (slots are hashed)."""
    rng = random.Random(6)
    pieces = ["a", "The", "word,", "x9", "42", "...", "é!", "中文", "LOUD!!!", "(see", "a|b", "end.", "longerword", "$5"]
    made = [" ".join(rng.choice(pieces[: rng.choice((3, 14))]) for _ in range(rng.randint(0, 25))) for _ in range(80)]
    text = next(textarrays.texts(pa.array(made)))
    slots, rows, counts = quality_classifier.occurrences(text)
    of = [shapes(t) for t in made]
    assert counts.tolist() == [len(s) for s in of]
    at = sum(n + max(0, n - 1) for n in counts.tolist())  # words' 1- and 2-grams come first
    for n in (1, 2, 3):
        want = [(r, tuple(s[k : k + n])) for r, s in enumerate(of) for k in range(len(s) - n + 1)]
        assert rows[at : at + len(want)].tolist() == [r for r, _ in want]
        slot_of, kinds = {}, {kind for _, kind in want}
        for (_, kind), slot in zip(want, slots[at : at + len(want)].tolist(), strict=True):
            assert slot_of.setdefault(kind, slot) == slot
        assert len(kinds) > 20 and len(set(slot_of.values())) >= 0.98 * len(kinds)
        at += len(want)
    assert at == len(slots)


def plain_forest(x, y, weight, trees, depth, rate, bins, ridge):
    """Margins of the training rows by loops over rows, nodes, features and cuts."""
    n = len(y)
    cuts = [sorted(set(np.quantile([r[j] for r in x], np.linspace(0, 1, bins + 1)[1:-1]).tolist())) for j in range(len(x[0]))]
    binned = [[sum(c < v for c in cuts[j]) for j, v in enumerate(r)] for r in x]
    share = min(max(sum(w * t for w, t in zip(weight, y, strict=True)) / sum(weight), 1e-3), 1 - 1e-3)
    f = [float(np.log(share / (1 - share)))] * n
    for _ in range(trees):
        p = [1 / (1 + np.exp(-v)) for v in f]
        g, h = [w * (a - t) for w, a, t in zip(weight, p, y, strict=True)], [w * a * (1 - a) for w, a in zip(weight, p, strict=True)]
        groups = [list(range(n))]
        for _ in range(depth):
            split = []
            for rows in groups:
                score = lambda part: sum(g[i] for i in part) ** 2 / (sum(h[i] for i in part) + ridge)  # noqa: B023, E731
                best = (-1.0, 0, bins + 1)
                for j in range(len(x[0])):
                    tried = [(score([i for i in rows if binned[i][j] <= k]) + score([i for i in rows if binned[i][j] > k]) - score(rows), k) for k in range(bins + 1)]
                    gain, k = max(tried, key=lambda v: v[0])
                    if gain > best[0] + 1e-9:
                        best = (gain, j, k)
                _, j, k = best
                split += [[i for i in rows if binned[i][j] <= k], [i for i in rows if binned[i][j] > k]]
            groups = split
        for rows in groups:
            value = -rate * sum(g[i] for i in rows) / (sum(h[i] for i in rows) + ridge)
            for i in rows:
                f[i] += value
    return f


def test_forest_against_plain_loops():
    rng = np.random.default_rng(3)
    x, weight = rng.normal(size=(70, 3)), rng.uniform(0.5, 2, 70)
    y = (x[:, 0] * x[:, 1] + 0.3 * rng.normal(size=70) > 0).astype(float)
    forest = toxicity.Forest(trees=4, depth=2, rate=0.3, bins=6).fit(x, y, weight)
    assert forest.margin(x) == pytest.approx(plain_forest(x.tolist(), y.tolist(), weight.tolist(), 4, 2, 0.3, 6, 1.0), abs=1e-9)
    assert toxicity.Forest().margin(x).tolist() == [0.0] * 70


def test_isotonic_against_the_min_max_formula():
    rng = random.Random(1)
    for n in itertools.chain(range(1, 12), [40] * 20):
        x = np.array([rng.randrange(n) / 2 for _ in range(n)])
        y, w = np.array([float(rng.random() < 0.2 + 0.6 * v / max(1, n)) for v in x]), np.array([rng.choice((0.5, 1.0, 2.0)) for _ in x])
        places = sorted(set(x.tolist()))
        mean = lambda a, b: np.average(y[(x >= places[a]) & (x <= places[b])], weights=w[(x >= places[a]) & (x <= places[b])])  # noqa: B023, E731
        want = [max(min(mean(a, b) for b in range(k, len(places))) for a in range(k + 1)) for k in range(len(places))]
        assert np.interp(places, *toxicity.isotonic(x, y, w)) == pytest.approx(want)
