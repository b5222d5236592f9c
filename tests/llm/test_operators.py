"""The ten operators against brute force, exact round trips and held-out labels, and on awkward rows."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest import compare
from pyspark.sql import functions as F

from stratalog.llm import ann, entry, labelled, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, textarrays, token_counts, tokens, toxicity, url_filter
from stratalog.llm.scratch import FREE_SHUFFLES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows_of(small, name, columns="*"):
    return duckdb.connect().sql(f"SELECT {columns} FROM '{Path(small) / name}.parquet'").fetchall()


def docs(spark, *texts, source="s"):
    return spark.createDataFrame([(k, t, "en", source, len(t or "")) for k, t in enumerate(texts)], DOCS)


AWKWARD = [(None, "a b c d e f", None, None, None), (1, None, "en", "s", None), (2, "", "en", "s", 0), (3, " \n\t\r\n ", "en", None, 5), (4, "one", "en", "s", 3), (4, "one", "en", "s", 3), (5, "x " * 30000, "en", "t", 60000), (6, "é中😀 a\u00a0b " * 50, "en", "t", 9), (7, "l1 a\nl2 b\nl3 c\nl1 a\nl2 b\nl3 c", "en", "t", 9), (None, None, None, None, None), (8, "\x00\x0b<|endoftext|>\x85", "en", "s", 9)]


EXTRA = ("id", "row", "rep", "bucket", "root", "size", "key", "slice", "lines", "words", "host", "path", "rule", "mix", "tie", "of", "score", "__text", "toxicity_score", "position", "y", "order", "one")


@pytest.fixture
def awkward(spark):
    """Nulls anywhere, empty and long texts, repeated rows, and columns whose names the operators use themselves."""
    return spark.createDataFrame(AWKWARD, DOCS).withColumns({c: F.lit(k).cast("int") for k, c in enumerate(EXTRA)})


def test_words_and_hashes():
    rng = random.Random(1)
    made = ["".join(rng.choice(" \n\taBé中x\x85") for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", "a"]
    seen = {}
    for text in textarrays.texts(pa.array(made), 500):
        starts, ends, rows = text.words()
        hashes = text.span_hashes(starts, ends)
        for a, b, h in zip(starts, ends, hashes, strict=True):
            assert seen.setdefault(bytes(text.data[a:b]), h) == h
        for k in range(text.rows):
            assert [bytes(text.data[a:b]).decode() for a, b in zip(starts[rows == k], ends[rows == k], strict=True)] == WORD.findall(made[text.first_row + k] or "")
    assert len(set(seen.values())) == len(seen)


# 1, 2: classifiers


@pytest.mark.parametrize(
    ("name", "sf", "label", "folds", "held", "recall", "precision"),
    [("op1_quality_classifier", "sf0.1", "quality", 4, 2, 0.98, 0.98), ("op2_toxicity", "sf0.1", "toxic", 3, 1, 0.9, 0.97), ("op1_quality_classifier", "sf0.01", "quality", 4, 2, 0.95, 0.95), ("op2_toxicity", "sf0.01", "toxic", 3, 1, 0.6, 0.9)],
)
def test_held_out_labels(spark, name, sf, label, folds, held, recall, precision):
    """About 7 % of the labels of toxic texts stand on texts without any sign of it: no bar of 1."""
    sf = f"/root/testdata/{sf}"
    got = entry.QUERIES[name](spark, sf).toPandas().set_index("doc_id")
    assert len(got) == len(rows_of(sf, "documents", "doc_id")) and got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.7)).all()
    assert all(got.held_out == [zlib.crc32(str(i).encode()) % folds == held for i in got.index])
    truth = dict(rows_of(sf, "labels", f"doc_id, {label}"))
    judged = [(truth[i], r.predicted) for i, r in got[got.held_out].iterrows() if i in truth]
    caught = sum(a == b == 1 for a, b in judged)
    assert caught >= recall * sum(a for a, _ in judged) and caught >= precision * sum(b for _, b in judged)


@pytest.mark.parametrize("module", [quality_classifier, toxicity])
def test_classifiers_on_awkward_rows(spark, small, awkward, module):
    labels, real = spark.read.parquet(f"{small}/labels.parquet"), spark.read.parquet(f"{small}/documents.parquet")
    label = "quality" if module is quality_classifier else "toxic"
    got = module.score(awkward, module.train(real, labels, F.lit(True), label)).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 for r in got)
    assert [set(r["row"].asDict()) for r in got] == [set(awkward.columns) - {"text"}] * len(got)
    extra = {c: k for k, c in enumerate(EXTRA)}
    assert all(r["row"][c] == k for r in got for c, k in extra.items())
    assert Counter(r["row"]["doc_id"] for r in got) == Counter(r[0] for r in AWKWARD)
    empty = module.train(real, labels.limit(0), F.lit(True), label)
    assert {r["score"] for r in module.score(awkward, empty).collect()} == {0.5}
    assert module.score(real.limit(0), empty).count() == 0
    contradictory = spark.createDataFrame([(0, 0, 0), (0, 1, 1), (None, 1, 1), (1, None, None)], "doc_id bigint, quality int, toxic int")
    assert labelled.sample(real, contradictory, label, F.lit(True), "doc_id", "text", (5, 5))[0].count() == 0


def test_sample_has_one_row_per_id(spark):
    df = docs(spark, *(f"t{k}" for k in range(30))).union(docs(spark, *(f"other {k % 7}" for k in range(50))).withColumn("doc_id", F.lit(3)))
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id bigint, quality int")
    chosen, totals = labelled.sample(df, labels, "quality", F.lit(True), "doc_id", "text", (5, 100))
    assert totals == {0: 15, 1: 15} and Counter(r["y"] for r in chosen.collect()) == {0: 5, 1: 15}


def test_follow_leader_against_a_plain_loop():
    """FTRL-proximal, weight by weight, in plain Python."""
    rng = random.Random(2)
    made = []
    for _ in range(60):
        y = rng.randint(0, 1)
        slots = sorted(rng.sample(range(40), 6)) + [100 + y]
        made.append((y, rng.choice([0.7, 1.3]), np.array(slots, np.int32), np.array([rng.uniform(0.1, 2) for _ in slots], np.float32)))
    z, n = defaultdict(float), defaultdict(float)
    q = quality_classifier

    def weight(k):
        return 0.0 if abs(z[k]) <= q.L1 else (math.copysign(q.L1, z[k]) - z[k]) / ((q.BETA + math.sqrt(n[k])) / q.ALPHA + q.L2)

    for _ in range(3):
        for y, c, slots, values in made:
            x = {**dict(zip(slots.tolist(), values.tolist(), strict=True)), q.DIMENSIONS: 1.0}
            w = {k: weight(k) for k in x}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in x.items())))
            for k, v in x.items():
                g = c * (p - y) * v
                s = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / q.ALPHA
                z[k] += g - s * w[k]
                n[k] += g * g
    got = q.follow_leader(made, epochs=3)
    assert got.nonzero()[0].tolist() == sorted(k for k in z if weight(k)) and all(got[k] == pytest.approx(weight(k), rel=1e-5) for k in z)


def test_word_ngrams_against_plain_counts():
    """Word 1- and 2-grams fall into slots by their own text: equal ones together, in the numbers of a plain count."""
    made = ["Aa b aa B c", "b aa", "", "aa"]
    text = next(textarrays.texts(pa.array(made)))
    slots, rows, counts = quality_classifier.occurrences(text)
    assert counts.tolist() == [5, 2, 0, 1] and len(slots) == len(rows) == sum((n + max(0, n - 1)) + (n + max(0, n - 1) + max(0, n - 2)) for n in counts.tolist())
    of = lambda r: Counter(slots[rows == r][: counts[r]].tolist())
    one = slots[: counts.sum()]  # 1-grams of words come first
    assert one[0] == one[2] == one[6] == one[7] and one[1] == one[3] == one[5] and len(set(one.tolist())) == 3 and sum(of(0).values()) == 5
    two = slots[counts.sum() : counts.sum() + 5]
    assert two[0] == two[2] and two[1] == two[4] and len(set(two.tolist())) == 3


def test_lexicon_against_plain_counts(spark):
    """Selected terms and their log-odds from a plain count over the sample; no limit on their number."""
    rng = random.Random(8)
    rows = []
    for k in range(400):
        y = int(k % 8 == 0)
        words = [f"common{chr(97 + rng.randrange(20))}" for _ in range(20)] + ([f"bad{chr(97 + j)}" for j in rng.sample(range(26), 13)] if y else [])
        rows.append((" ".join(words), y, k // 8 % toxicity.FOLDS))
    rows.append((None, 0, 0))
    got = toxicity.lexicons(spark.createDataFrame(rows, "text string, y int, fold int"))
    for f, lexicon in enumerate(got):
        own = [(set((t or "").split()), y) for t, y, fold in rows if f == toxicity.FOLDS or fold != f]
        sizes = Counter(y for _, y in own)
        base = sizes[1] / len(own)
        want = {}
        for word in {w for s, _ in own for w in s}:
            n = Counter(y for s, y in own if word in s)
            share = n[1] / (n[0] + n[1])
            evidence = (n[1] * math.log(share / base) if n[1] else 0) + (n[0] * math.log((1 - share) / (1 - base)) if n[0] else 0)
            if n[1] >= 3 and share >= 0.4 and share > base and evidence >= 9:
                want[word] = max(0.1, math.log((n[1] + 0.5) / (n[0] + 0.5) * (sizes[0] + 1) / (sizes[1] + 1)))
        keys = {w: toxicity.normal_words(next(textarrays.texts(pa.array([w]))))[4][0][0] for w in {w for s, _ in own for w in s}}
        weights = lexicon.of(np.array([keys[w] for w in keys], np.uint64))
        assert len(want) == 26 and {w: v for w, v in zip(keys, weights, strict=True) if v} == pytest.approx(want)


def test_dense_features():
    text = next(textarrays.texts(pa.array(["You IDIOT, you st*pid fool!! and a b c d e f g h moron", "Fine words."])))
    got = dict(zip(toxicity.FEATURES, toxicity.features(text, toxicity._with_insults(np.zeros(0, np.uint64), np.zeros(0))).T, strict=True))
    raw = "You IDIOT, you st*pid fool!! and a b c d e f g h moron"
    assert got["words"].tolist() == pytest.approx([math.log1p(15), math.log1p(2)]) and got["hits"].tolist() == pytest.approx([math.log1p(3), 0])
    assert got["density"].tolist() == pytest.approx([3 / 15, 0]) and got["near_second_person"].tolist() == [2, 0] and got["second_person"].tolist() == pytest.approx([2 / 15, 0])
    assert got["capitals"][0] == pytest.approx(sum(c.isupper() for c in raw) / len(raw)) and got["exclamation"][0] == pytest.approx(2 / len(raw))
    assert got["punctuation"][0] == pytest.approx(sum(c in "*,!" for c in raw) / len(raw)) and got["obfuscation"].tolist() == pytest.approx([1 / 15, 0])


def test_isotonic_and_forest():
    rng = np.random.default_rng(0)
    x = rng.random((400, 3))
    y = (x[:, 1] > 0.6).astype(float)
    forest = toxicity.Forest(trees=20).fit(x, y, np.ones(400))
    assert ((forest.margin(x) > 0) == (y == 1)).mean() > 0.97
    at, value = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 0]), np.ones(5))
    assert (np.diff(value) >= 0).all() and np.interp(2.5, at, value) == 0.5


def test_normal_form():
    lexicon = toxicity.Lexicon(toxicity.normal_words(next(textarrays.texts(pa.array(["loser"]))))[4][0], np.ones(1))
    hits = toxicity.features(next(textarrays.texts(pa.array(["you L0ser!", "lo*ser.", "closer", ""]))), lexicon)[:, 1]
    assert [round(math.expm1(h)) for h in hits] == [1, 1, 0, 0]


# 3: quality rules


def expected_counts(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + d for k, g in enumerate(zip(w, w[1:], w[2:], strict=False)) if grams[g] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, small, awkward):
    for df in (spark.read.parquet(f"{small}/documents.parquet"), awkward):
        for r in quality_rules.judged(df).collect():
            counts = expected_counts(r["row"]["text"])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts
            assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0]) and not (r["base_failed"] and r["kept"])
    assert quality_rules.judged(awkward.limit(0)).count() == 0


def test_blanks_of_lines(spark):
    """The six ASCII blanks around a line don't count, and no letter is taken for one of them."""
    rng = random.Random(12)
    made = ["f\nf\nff", "\x0c\n\x0c\na", "\x0b\n \x0b\n\x85\n\x85", "for half\nor half\nfor half"]
    made += ["\n".join("".join(rng.choice("f\x0b\x0c \ta\r") for _ in range(rng.randint(0, 4))) for _ in range(rng.randint(1, 12))) for _ in range(200)]
    got = {r["row"]["doc_id"]: r for r in quality_rules.judged(docs(spark, *made)).collect()}
    for k, text in enumerate(made):
        assert (got[k]["n_words"], got[k]["word_chars"], got[k]["n_symbols"], got[k]["n_dup_lines"], got[k]["n_repeat_words"]) == expected_counts(text)
    whole = "\n".join(f"f{k} ff for half of the wolf, if fluff is stiff f{k}f." for k in range(9))
    assert quality_rules.judged(docs(spark, "\x0c " + whole.replace("\n", " \x0b\n\x0c") + "\x0c")).collect()[0]["clean_text"] == whole


def test_quality_verdicts(spark):
    rng = random.Random(3)
    good = "\n".join(" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(12)) + "." for _ in range(8))
    menu = good + "\n" + "\n".join(" | ".join(f"{rng.random():.9f}" for _ in range(20)) for _ in range(9))
    furniture = "\n".join(f"Read more about item {k} {rng.random()} and accept our cookie policy." for k in range(9))
    got = [r["kept"] for r in quality_rules.judged(docs(spark, good, menu, furniture, good.upper(), good + "\nHome | About | Contact")).collect()]
    assert got == [True, False, False, False, True]
    assert "Contact" not in quality_rules.judged(docs(spark, good + "\nHome | About | Contact")).collect()[0]["clean_text"]


def test_quality_lines_without_symbols_or_repeats_elsewhere(spark):
    """Rules on lines hold in documents without other symbols and without a repeated window of words."""
    rng = random.Random(4)
    good = "\n".join(" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(12)) + "." for _ in range(8))
    bad = [f"ab{c}cd. ef{c}" for c in "#*$%&|<>{}=~^\\"] + ["ab." + " " * 30 + "cd", "ab ab ab cd. cd. cd. ab cd. ab ab"]
    fine = ["ab{cd. ef gh ij kl", "ab." + " " * 8 + "cd", "ab cd ef cd. cd. cd. ab cd. ab ab"]
    got = {r["row"]["doc_id"]: r for r in quality_rules.judged(docs(spark, *(good + "\n" + x for x in bad + fine))).collect()}
    assert not any(r["n_repeat_words"] for r in got.values())
    assert [got[k]["clean_text"] for k in range(len(got))] == [good] * len(bad) + [good + "\n" + x for x in fine]


# 4: near-duplicates


def shingles(text):
    w = [x.translate(str.maketrans(url_filter.UPPER, url_filter.LOWER)) for x in WORD.findall(text or "")]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def groups(sets):
    """Smallest reachable key by key, comparing all pairs that share a shingle."""
    root, holders, shared = {k: k for k in sets}, defaultdict(list), Counter()
    for k, s in sets.items():
        for g in s:
            shared.update((other, k) for other in holders[g])
            holders[g].append(k)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {k: find(k) for k in sets}


def check_groups(df, rows):
    sets = {i: shingles(t) for i, t in rows}
    want = groups(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_on_documents(spark, small):
    check_groups(entry.QUERIES["op4_minhash_near_dedup"](spark, small), rows_of(small, "documents", "doc_id, text"))


def test_families_of_edited_copies(spark):
    """Copies at 0.6 to 0.95 of a common text, so that buckets hold linked and unlinked members and chains."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    made = []
    for _ in range(6):
        base = [word() for _ in range(120)]
        for _ in range(30):
            copy = list(base)
            for _ in range(rng.randint(0, 7)):
                copy[rng.randrange(120)] = word()
            made.append(" ".join(copy))
    made += [" ".join(word() for _ in range(n)) for n in range(0, 12)] + ["Aa b c d e F", "aA B c d e f", "a b c", "a b c"]
    rng.shuffle(made)
    check_groups(near_dedup.near_duplicates(docs(spark, *made)), list(enumerate(made)))


def test_sweep_finds_what_stars_miss(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SWEEP", 150)
    monkeypatch.setattr(near_dedup, "GROUP", 3)
    base = [f"w{k}" for k in range(100)]
    far = lambda n, tag: base[:n] + [f"{tag}{k}" for k in range(100 - n)]
    made = [" ".join(base), *(" ".join([*far(80, "a")[:98], f"t{k}", f"u{k}"]) for k in range(6)), *(" ".join([*far(78, "b")[:98], f"t{k}", f"u{k}"]) for k in range(6))]
    check_groups(near_dedup.near_duplicates(docs(spark, *made)), list(enumerate(made)))


def test_sweep_index_against_all_pairs():
    """Looking up the rarest quarter of a set first loses no link."""
    rng = np.random.default_rng(11)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 60, rng.integers(1, 60), dtype=np.uint64)
        for _ in range(8):
            own = np.where(rng.random(len(base)) < rng.uniform(0, 0.3), rng.integers(0, 1 << 60, len(base), dtype=np.uint64), base)
            sets.append(np.unique(np.concatenate([own[: rng.integers(max(1, len(own) - 8), len(own) + 1)], rng.integers(0, 12, 2, dtype=np.uint64)])))
    index = near_dedup._Sets(list(range(len(sets))), [0] * len(sets), sets)
    plain = [set(s.tolist()) for s in sets]
    for s, own in zip(sets, plain, strict=True):
        assert index.linked(s).tolist() == [k for k, other in enumerate(plain) if 100 * len(own & other) >= 75 * len(own | other)]
    assert len(index.linked(np.zeros(0, np.uint64))) == 0


def test_common_passages_without_links(spark):
    """Many texts that share well below three quarters of their shingles meet in buckets and stay apart."""
    rng = random.Random(13)
    common = [f"c{k}" for k in range(90)]
    made = [" ".join(common + [f"u{k}x{rng.random()}" for _ in range(60)]) for k in range(150)]
    check_groups(near_dedup.near_duplicates(docs(spark, *made)), list(enumerate(made)))


def test_near_duplicates_on_awkward_rows(spark, awkward):
    got = near_dedup.near_duplicates(awkward).collect()
    assert len(got) == len(AWKWARD)
    assert all(r["kept"] and r["component_id"] == r["doc_id"] for r in got)
    assert near_dedup.near_duplicates(awkward.limit(0)).count() == 0


def test_ids_with_several_texts(spark):
    """An id is one node: its texts tie their classes, and all its rows share the decision."""
    text = lambda tag: " ".join(f"{tag}{k}" for k in range(40))
    rows = [(1, text("x")), (2, text("y")), (3, text("x")), (3, text("y")), (4, text("z")), (5, text("z")), (5, ""), (5, None), (6, text("u")), (6, text("v")), (7, text("v")), (8, ""), (8, None), (9, text("w")), (9, ""), (None, text("x")), (None, text("w"))]
    rows += [(12, text("p")), (12, text("q")), (11, text("q")), (11, text("r")), (10, text("r") + " r40")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    got = near_dedup.near_duplicates(df).collect()
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 6, 8: 8, 9: 9, 10: 10, 11: 10, 12: 10, None: None}
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in got} == {(i, c, i == c) for i, c in want.items()}


# 5: neighbours


def check_recall(df, vectors, k, least):
    ids, x = np.array([i for i, _ in vectors]), np.array([v for _, v in vectors], float)
    got = defaultdict(list)
    for r in df.orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = (x * x[q]).sum(1)
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != ids[q]][:k]
        found = got[ids[q]]
        assert len(found) == len(order) and found == sorted(found, key=lambda p: (-p[1], p[0]))
        assert all(abs(s - score[np.flatnonzero(ids == v)[0]]) < 1e-12 for v, s in found)
        hit, total = hit + len({v for v, _ in found} & set(ids[order])), total + len(order)
    assert hit / total >= least


def test_nearest_recall(spark, small):
    check_recall(entry.QUERIES["op5_collision_counting_ann"](spark, small), rows_of(small, "embeddings", "vec_id, embedding"), 20, 0.95)


def test_nearest_of_clusters_and_lengths(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((10, 16))[rng.integers(0, 10, 1500)] + 0.05 * rng.standard_normal((1500, 16)), np.repeat(rng.standard_normal((1, 16)), 300, 0)]) * rng.uniform(0.1, 5, (1800, 1))
    x[1500:] = x[1500]
    vectors = [(k, v.tolist()) for k, v in enumerate(x)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    check_recall(ann.nearest(df, F.col("id") % 20 == 0), vectors, 20, 0.9)


def clustered(rng, clusters, each, size, spread):
    return np.repeat(rng.standard_normal((clusters, size)), each, 0) + spread * rng.standard_normal((clusters * each, size))


def test_windows_pass_fewer_rows_than_a_scan():
    """On clustered rows the windows' mean size and the verified rows stay well below all rows, at full recall."""
    rng = np.random.default_rng(6)
    x = clustered(rng, 100, 40, 32, 0.02)
    x /= np.linalg.norm(x, axis=1)[:, None]
    index = ann.Index(np.arange(4000), np.arange(4000), x)
    asked = np.arange(0, 4000, 20)
    found = {i: ids for i, ids, _ in index.search(asked, x[asked], np.full(200, -np.inf), 20)}
    score = x[asked] @ x.T
    score[np.arange(200), asked] = -9
    hits = sum(len(set(found[i]) & set(np.argsort(-score[i])[:20])) for i in range(200))
    assert hits >= 0.95 * 4000 and index.counted / ann.PROJECTIONS + index.verified < 0.25 * 200 * 4000


def test_search_within_a_bound():
    """A bound that a home block gives leads to one round, and to nothing below it."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((500, 8))
    index = ann.Index(np.arange(500), np.arange(500), x)
    score = x[:50] @ x.T
    bounds = np.sort(score, 1)[:, -10]
    for i, ids, got in index.search(np.full(50, -1), x[:50], bounds, 20):
        assert len(ids) <= 10 and (got >= bounds[i]).all() and set(ids) <= set(np.flatnonzero(score[i] >= bounds[i] - 1e-12))


def test_pivots_that_cannot_reach_the_bound_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS", 100)
    rng = np.random.default_rng(8)
    x = clustered(rng, 20, 100, 16, 0.05)
    x /= np.linalg.norm(x, axis=1)[:, None]
    routed = []
    route = ann._open_cells
    monkeypatch.setattr(ann, "_open_cells", lambda *a: routed.append(route(*a)) or routed[-1])
    vectors = [(k, v.tolist()) for k, v in enumerate(x)]
    df = ann.nearest(spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>"), F.col("id") % 20 == 0)
    check_recall(df, vectors, 20, 0.95)
    assert routed[0].count() < 0.5 * 100 * 20


def test_every_row_that_asks_is_answered(spark):
    """Two rows with one id ask twice; repeated rows are candidates of each other."""
    rows = [(20, [1.0, 0.0]), (20, [0.0, 1.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (2, [0.0, 3.0]), (40, [1.0, 1.0]), (40, [1.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), F.col("id") % 20 == 0, k=2).collect()
    assert Counter(tuple(r) for r in got) == Counter([
        (20, 1, 1, 2.0), (20, 2, 40, 1.0), (20, 1, 2, 3.0), (20, 2, 2, 3.0), (40, 1, 2, 3.0), (40, 2, 2, 3.0), (40, 1, 2, 3.0), (40, 2, 2, 3.0),
    ])


def test_nearest_on_awkward_rows(spark):
    rows = [(0, [1.0, 0.0], 1), (20, [0.0, 1.0], 1), (1, [1.0, 0.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [None, 1.0], 1), (5, [float("nan"), 1.0], 1), (6, [float("inf"), 1.0], 1), (None, [1.0, 1.0], 1), (7, [1.0], 1), (40, [1.0, 2.0, 3.0], 1), (8, [], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, id int")
    got = [tuple(r) for r in ann.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 20, 0.0), (20, 1, 0, 0.0), (20, 2, 1, 0.0)]
    assert ann.nearest(df.limit(0), F.lit(True)).count() == 0


# 6, 8: tokens


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


HARD = ["x <|endoftext|> y<|endoftext|>", "", " ", "a" * 5000, "é中😀" * 300, "\n\n \n x", "  leading", "it's  we'll\t\t9999", "\x00\x0b\x85\u00a0", "x\n" * 400, "!?" * 3000]


def test_ids_equal_the_tokenizer(small, tokenizer):
    made = HARD + [t for _, t in rows_of(small, "documents", "doc_id, text")]
    for text in textarrays.texts(pa.array(made)):
        ids, edges = tokens.ids_of(text, tokens.encoder())
        for k in range(text.rows):
            assert ids[edges[k] : edges[k + 1]].tolist() == tokenizer.encode(made[text.first_row + k], add_special_tokens=False).ids


def test_special_token_in_texts(spark):
    """Its string is the special token, as with the tokenizer's default settings."""
    import public_tokenizers
    from tokenizers import Tokenizer

    default = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    made = [f"{a}<|endoftext|>{b}" for a in ("", "a ", "a  ", "é\n", "it'", "<|endoftext|>") for b in ("", " b", "  b", "\n\nb", "s", "|>")] + ["<|endoftext|", "plain"]
    want = [default.encode(t, add_special_tokens=False).ids for t in made]
    assert 50256 in want[0] and len(tokens.token_lengths()) == 50257 and tokens.token_bytes()[50256] == b"<|endoftext|>"
    for text in textarrays.texts(pa.array(made)):
        ids, edges = tokens.ids_of(text, tokens.encoder())
        for k in range(text.rows):
            assert ids[edges[k] : edges[k + 1]].tolist() == want[text.first_row + k]
    df = docs(spark, *made)
    counts = {r["doc_id"]: r["n_tokens"] for r in token_counts.document_tokens(df).collect()}
    assert [counts[k] for k in range(len(made))] == [len(x) for x in want]
    pieces = packing.pack(df, [df["doc_id"]], with_ids=True).orderBy("doc_id", "start").collect()
    assert all([i for r in pieces if r["doc_id"] == k for i in r["ids"]] == [*x, 0] for k, x in enumerate(want))


def test_section_tokens(spark, small, tokenizer):
    made = HARD + [t for _, t in rows_of(small, "documents", "doc_id, text")]
    got = defaultdict(list)
    for r in token_counts.section_tokens(docs(spark, *made)).orderBy("doc_id", "section").collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    for k, text in enumerate(made):
        lines = text.splitlines(keepends=True) if not re.search("[\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", text) else re.findall("[^\n]*\n|[^\n]+", text)
        ends = list(itertools.accumulate(map(len, lines))) or [0]
        assert [(s[0], s[1], s[2]) for s in got[k]] == [(i, a, b) for i, (a, b) in enumerate(zip([0, *ends], ends, strict=False))]
        spans = token_spans(tokenizer, text)
        owner, crossing = Counter(), Counter()
        edges = [len(text[:b].encode()) for b in ends]
        for first, last in spans:
            k_line = sum(e <= first for e in edges)
            owner[k_line] += 1
            crossing[k_line] += last > edges[k_line]
        assert [(s[3], s[4]) for s in got[k]] == [(owner[i], crossing[i]) for i in range(len(got[k]))]
        assert sum(s[3] for s in got[k]) == len(spans)
    assert sum(s[4] for rows in got.values() for s in rows) > 0


def token_spans(tokenizer, text):
    """Bytes of each token by the tokenizer's own vocabulary: a byte-level token's characters stand for its bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    bytes_of = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
    at, out = 0, []
    for token in tokenizer.encode(text, add_special_tokens=False).tokens:
        raw = token.encode() if token == "<|endoftext|>" else bytes(bytes_of[c] for c in token)
        assert text.encode()[at : at + len(raw)] == raw
        out.append((at, at + len(raw)))
        at += len(raw)
    assert at == len(text.encode())
    return out


def test_tokens_that_cross_sections(spark, tokenizer):
    """Blank lines make tokens that begin in one line and end in another: the line of the first byte has them."""
    got = token_counts.section_tokens(docs(spark, "a\n\n\n\nb", "é\n \n é\n\n")).orderBy("doc_id", "section").collect()
    spans = token_spans(tokenizer, "a\n\n\n\nb")
    assert any("\n\n" in "a\n\n\n\nb"[a:b] for a, b in spans)
    assert sum(r["n_crossing"] for r in got if r["doc_id"] == 0) == sum("\n" in "a\n\n\n\nb"[a : b - 1] for a, b in spans) > 0


def test_tokens_on_awkward_rows(spark, awkward):
    got = token_counts.document_tokens(awkward).count()
    assert got == len({r[0] for r in AWKWARD})
    assert token_counts.section_tokens(awkward.limit(0)).count() == 0
    pieces = packing.pack(awkward, [awkward["doc_id"]]).collect()
    assert Counter(r["doc_id"] for r in pieces if r["start"] == 0) == Counter(r[0] for r in AWKWARD)
    assert packing.pack(awkward.limit(0), [awkward["doc_id"]]).count() == 0


def test_packing_round_trip(spark, small, tokenizer):
    made = HARD + [t for _, t in rows_of(small, "documents", "doc_id, text")]
    df = docs(spark, *made)
    pieces = packing.pack(df, [df["doc_id"]], with_ids=True).toPandas()
    assert (pieces["ids"].map(len) == pieces["length"]).all() and (pieces["length"] > 0).all()
    assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(pieces["ids"], pieces["ids_crc32"], strict=True))
    for doc, part in pieces.sort_values(["doc_id", "start"]).groupby("doc_id"):
        ids = [x for i in part["ids"] for x in i]
        assert ids == [*tokenizer.encode(made[doc], add_special_tokens=False).ids, 0] and set(part["doc_tokens"]) == {len(ids)}
        assert part["start"].tolist() == [0, *part["length"].cumsum()][:-1]
    padding, previous = 0, -1
    for _, part in pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id"):
        total = part["length"].sum()
        assert total <= 1024 and part["offset"].tolist() == [0, *part["length"].cumsum()][:-1]
        padding += 0 if total & (total - 1) == 0 else 1024 - total
        assert part["doc_id"].is_monotonic_increasing and part["doc_id"].iloc[0] >= previous
        previous = part["doc_id"].iloc[-1]
    assert padding < 0.03 * pieces["length"].sum()


def test_cuts_lie_at_sentence_ends(spark, small):
    """Inside a document a cut follows a line end or a sentence's end, unless more than 1024 tokens hold neither."""
    made = [t for _, t in rows_of(small, "documents", "doc_id, text")] + ["a, b " * 3000 + ". " + "word. " * 50, 'He said "no." Then (yes!) 3.14 e.g.x ' * 400]
    df = docs(spark, *made)
    pieces, forced = packing.pack(df, [df["doc_id"]], with_ids=True).collect(), 0
    bodies = defaultdict(dict)
    for r in pieces:
        bodies[r["doc_id"]][r["start"]] = b"".join(tokens.token_bytes()[i] for i in r["ids"])
    for k, parts in bodies.items():
        starts = sorted(parts)
        for a, b in itertools.pairwise(starts):
            before, after = b"".join(parts[s] for s in starts if s <= a), parts[b]
            if not (before.endswith(b"\n") or re.search(rb"[.!?][\"')\]}]*$", before) and after[:1] in (b" ", b"\n", b"\t", b"\r")):
                forced += 1
                assert k == len(made) - 2 or max(map(len, re.split(r"\n|[.!?](?=\s)", made[k]))) > 1024
    assert forced > 0


def test_cuts_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(30):
        at = np.concatenate([[0], np.cumsum(rng.integers(1, 300, 40))])
        cost = rng.choice([0.0, 1.0, 6.0], len(at))
        price = lambda n: packing.OPEN + (0 if n & (n - 1) == 0 else 1024 - n)
        best = [0.0]
        for j in range(1, len(at)):
            best.append(cost[j] + min(best[i] + price(int(at[j] - at[i])) for i in range(j) if at[j] - at[i] <= 1024))
        cuts = packing.best_cuts(at, cost)
        places = np.concatenate([[0], at[cuts]])
        assert cuts[-1] == len(at) - 1 and (np.diff(places) <= 1024).all()
        assert sum(price(int(d)) for d in np.diff(places)) + cost[cuts].sum() == pytest.approx(best[-1])


# 7: mixing


def water(sizes, weights, total, passes=2):
    """Targets by resharing the excess of capped sources until none is above its cap."""
    out, open_, left = {}, dict(weights), total
    while open_:
        share = left / sum(open_.values())
        full = [s for s, w in open_.items() if w * share >= passes * sizes[s]]
        if not full:
            return out | {s: w * share for s, w in open_.items()}
        for s in full:
            out[s] = passes * sizes[s]
            left -= out[s]
            del open_[s]
    return out


def check_mix(df, rows):
    sizes, ids = Counter(), Counter()
    for i, source, text in rows:
        sizes[source] += len(WORD.findall(text or ""))
        ids[i] += 1
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    targets = water(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    by_id = dict((i, s) for i, s, _ in rows)
    taken, largest, got = Counter(), Counter(), df.collect()
    assert Counter(r["doc_id"] for r in got) == ids
    for r in got:
        s = by_id[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(targets[s]) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
        assert all(p is None or 0 <= p <= 1 for p in (r["first_position"], r["second_position"]))
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in sizes)
    return [tuple(r) for r in got]


def test_mixing(spark, small):
    rows = rows_of(small, "documents", "doc_id, source, text")
    once = check_mix(entry.QUERIES["op7_curriculum_mixing"](spark, small), rows)
    assert sorted(map(str, once)) == sorted(map(str, check_mix(entry.QUERIES["op7_curriculum_mixing"](spark, small), rows)))


def test_mixing_of_one_id(spark):
    """Null and repeated ids are mixed like others: their texts spread them over the order and its slices."""
    rows = [(None if k % 2 else 7, f"w{k} " * (k % 9 + 1), "en", "st"[k % 3 == 0], 0) for k in range(600)]
    got = mixing.mixed(spark.createDataFrame(rows, DOCS), keep=["source"]).select("row.source", "mix.*").collect()
    assert len(got) == 600
    for source in "st":
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 9 and len({p for r in own for p in r["positions"]}) == sum(len(r["positions"]) for r in own)


def test_mixing_on_awkward_rows(spark, awkward):
    assert mixing.mixed(awkward, keep=["doc_id", "tie"]).select("row.*").columns == ["doc_id", "tie"]
    assert mixing.mixed(awkward).count() == len(AWKWARD)
    assert mixing.mixed(awkward.limit(0)).count() == 0
    assert all(r["taken"] == 0 for r in mixing.mixed(docs(spark, None, "", " ")).select("mix.*").collect())
    assert mixing.curriculum(awkward).columns == awkward.columns


def test_positions_invert_the_schedule(spark):
    schedule = ((0.0, 0.5), (0.25, 2.0), (0.5, 2.0), (1.0, 0.0))
    area = lambda t: sum(max(0.0, min(t, b) - a) * (w + (min(t, b) - a) * (v - w) / (b - a) / 2) for (a, w), (b, v) in zip(schedule, schedule[1:], strict=False) if t > a)
    got = spark.range(0, 1001).select((F.col("id") / 1000).alias("s"), mixing.position(F.col("id") / 1000, schedule).alias("t")).collect()
    assert all(area(r["t"]) / area(1.0) + w0 == pytest.approx(r["s"], abs=1e-6) for r in got for w0 in (0,))
    assert [r["t"] for r in got] == sorted(r["t"] for r in got)


def test_curriculum_is_sorted(spark):
    df = docs(spark, *(f"w{k} " * (k % 7 + 1) for k in range(300)))
    order = {r["row"]["doc_id"]: r["mix"]["positions"] for r in mixing.mixed(df).collect()}
    rows = [r["doc_id"] for r in mixing.curriculum(df).collect()]
    assert Counter(rows) == Counter({k: len(p) for k, p in order.items() if p})
    seen = Counter()
    at = []
    for k in rows:
        at.append(order[k][seen[k]])
        seen[k] += 1
    assert at == sorted(at)


# 9, 10: with SQL


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_against_sql(spark, small, name):
    got, want = compare(entry.QUERIES[name](spark, small), entry.ORACLE_SQL[name], small)
    assert got == want


def test_url_rules(spark):
    urls = [None, "", "no scheme/en/", "http://", "http://net", "http://NET/", "https://a.b.net/x?q=http://org/fr/", "ftp://example.net/en/x#y", "http://xexample.net/en/", "http://example.net/EN/", "http://a.org/fr/1", "http://org/fr", "http://www.example.com/de/", "http://example.com?x=/de/", "x://y://net/", "http://a..net/", "http://" + "a." * 5000 + "net/" + "b" * 5000, "HTTP://Exämple.NET/en/", "line\nhttp://net/\n"]
    pages = spark.createDataFrame([(k, u, "h", "p", "r") for k, u in enumerate([*urls, urls[5]])], "page_id bigint, url string, host string, path string, row string")
    rules = spark.createDataFrame(entry.URL_RULES, "host string, path string, verdict string")
    got = {r["row"]["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    assert len(got) == len(urls) + 1

    def brute(url):
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = re.match("[^/?#]*", rest)[0].translate(str.maketrans(url_filter.UPPER, url_filter.LOWER))
        path = re.match("[^?#]*", rest[len(re.match("[^/?#]*", rest)[0]) :])[0]
        fits = [(len(h + p), h + p, v) for h, p, v in entry.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[1:] if fits else (None, "allow")

    assert got == {k: brute(u) for k, u in enumerate([*urls, urls[5]])}
    more = spark.createDataFrame([("a.b", "", "block"), ("b", "/longer", "allow"), ("b", "/lo", "block"), (None, "/", "block"), ("b", None, "block"), ("a.b", "/12345", "allow")], "host string, path string, verdict string")
    asked = spark.createDataFrame([(1, "x://a.b"), (2, "x://b/longer/y"), (3, "x://b/loud"), (4, "x://a.b/12345"), (5, "x://c/")], "page_id bigint, url string")
    assert {r["row"]["page_id"]: r["rule"] for r in url_filter.judge(asked, more).collect()} == {1: "a.b", 2: "b/longer", 3: "b/lo", 4: "a.b/12345", 5: None}
    assert {r["verdict"] for r in url_filter.judge(asked, more.limit(0)).collect()} == {"allow"} and url_filter.judge(asked.limit(0), more).count() == 0


def brute_lines(rows, sentences=False):
    """Cleaned texts by (id, text), for ids without repeats."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        if text is None:
            out[i] = None
            continue
        lines, gone = text.split("\n"), set()
        units = [(i, u) for i, x in enumerate(lines) for u in (re.split(r"(?<=[.!?])(?=[ \t])", x) if sentences else [x])]
        body = [(k, x.strip(" \t\n\x0b\x0c\r")) for k, (_, x) in enumerate(units) if x.strip(" \t\n\x0b\x0c\r")]
        for (a, x), (_, y), (c, z) in zip(body, body[1:], body[2:], strict=False):
            if (x, y, z) in seen:
                gone |= set(range(a, c + 1))
            seen.add((x, y, z))
        left = itertools.groupby(((at, x) for k, (at, x) in enumerate(units) if k not in gone), key=lambda u: u[0])
        out[i] = "\n".join("".join(x for _, x in part) for _, part in left)
    return out


def test_line_dedup(spark):
    rng = random.Random(9)
    made = ["\n".join(rng.choice(["a", "b", " b ", "c", "", " \t", "d"]) for _ in range(rng.randint(0, 25))) for _ in range(120)] + [None, "", "\n\n", "x\ny"]
    rows = list(enumerate(made)) + [(None, "p\nq\nr"), (900, "p\nq\nr\ns")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"row": F.lit(1), "lines": F.lit(2), "covered": F.lit(3), "id": F.lit(4)})
    assert {r["row"]["doc_id"]: r["text"] for r in line_dedup.without_repeats(df).collect()} == brute_lines(rows)


def test_line_dedup_blanks(spark):
    """Lines that differ in a letter at their edge differ; the six ASCII blanks at the edge make no difference."""
    rng = random.Random(10)
    made = ["fan\nb\nc", "an\nb\nc", "if\nb\nc", "i\nb\nc", "\x0cp\nq\x0b\nr", "p\nq\nr"]
    made += ["\n".join(rng.choice(["f", "ff", "af", "a", "\x0c", "\x0b", "\x0ca", "f\x0b", "\x85a"]) for _ in range(rng.randint(0, 20))) for _ in range(80)]
    got = {r["row"]["doc_id"]: r["text"] for r in line_dedup.without_repeats(docs(spark, *made)).collect()}
    assert got == brute_lines(list(enumerate(made))) and [got[k] for k in range(6)] == [*made[:5], ""]


def test_line_dedup_of_sentences(spark):
    """A line is a line whatever its length; with ``sentences`` a passage on one line loses its later occurrences, and lines of any length are taken apart."""
    rng = random.Random(14)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    passage = ". ".join(words(15) for _ in range(5)) + "."
    made = [passage, f"{words(60)}. {passage}\t{words(20)}.", f"{words(9)}\n{passage}\n{words(9)}", words(70), words(70) + ".  3.14 e.g.x", "a. b. c.", "a. b. c.", "x! " * 60, "x! " * 60]
    made += [" ".join(rng.choice(["a b.", "c d! ", "e f?", "g.h", "\ti j.", "..."]) for _ in range(rng.randint(3, 40))) for _ in range(60)]
    rows = line_dedup.without_repeats(docs(spark, *made), sentences=True).collect()
    got = {r["row"]["doc_id"]: r["text"] for r in rows}
    assert got == brute_lines(list(enumerate(made)), True)
    assert [passage in got[k] for k in range(3)] == [True, False, False] and got[2].split("\n") == made[2].split("\n")[::2] and got[1] == made[1].replace(" " + passage, "")
    counts = {r["row"]["doc_id"]: (r["n_removed"], r["n_removed_sentences"]) for r in rows}
    assert [counts[k] for k in (0, 1, 2, 6)] == [(0, 0), (0, 5), (1, 5), (1, 3)] and got[6] == ""
    whole = {r["row"]["doc_id"]: r["text"] for r in line_dedup.without_repeats(docs(spark, *made)).collect()}
    assert whole == brute_lines(list(enumerate(made))) == dict(enumerate(made))


def test_line_dedup_of_lines_and_passages(spark, tmp_path):
    """Passages on one line go where they come again, and so do repeated lines; the columns of the lines stay theirs."""
    rng = random.Random(15)
    words = lambda n: " ".join("".join(rng.choices("abcdefghij", k=5)) for _ in range(n))
    passage = ". ".join(words(20) for _ in range(5)) + "."
    made = [f"{words(60)}. {passage}", f"{passage}\t{words(20)}.", f"{words(9)}\n{passage}\n{words(9)}", "a\nb. c\n \nd", "x\na\nb. c\n \nd", None, "", "a. b. c.", "a. b. c."]
    made += ["\n".join(rng.choice(["a b.", "c d! e f?", "g.h  i. j", "", "..."]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rows = {r["row"]["doc_id"]: r for r in line_dedup.without_repeated_passages(docs(spark, *made)).collect()}
    by_line, by_sentence = brute_lines(list(enumerate(made))), brute_lines(list(enumerate(made)), True)
    assert {k: r["text"] for k, r in rows.items()} == by_line and {k: r["passages_text"] for k, r in rows.items()} == by_sentence
    assert [passage in rows[k]["passages_text"] for k in range(3)] == [True, False, False] and all(rows[k]["text"] == made[k] for k in range(3))
    assert [(rows[k]["n_removed"], rows[k]["n_removed_sentences"]) for k in (2, 4, 5, 6, 8)] == [(0, 5), (4, 5), (0, 0), (0, 0), (0, 3)]
    # The query takes both: no passage that its SQL of round 2 removed, of long lines only, may stay.
    docs(spark, *made).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["passages_md5"] for r in entry.op10_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {k: None if t is None else hashlib.md5(t.encode()).hexdigest() for k, t in by_sentence.items()}


def test_line_dedup_keeps_one_step_on_disk(spark):
    """What first places and windows shuffled is gone before the texts are shuffled, and these are shuffled once."""
    def shuffled():
        paths = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {p: Path(p).stat().st_size for p in paths if re.search(r"shuffle_[^/]*\.data$", p) and Path(p).exists()}

    rng = random.Random(16)
    made = [f"{rng.randbytes(30000).hex()}" for _ in range(40)] + ["a. b. c. d\nb\nc"] * 40
    before, ran = set(shuffled()), spark.conf.get(FREE_SHUFFLES, None)
    clean = line_dedup.without_repeated_passages(docs(spark, *made))
    until = time.monotonic() + 20  # files are deleted soon, not at once
    while set(shuffled()) - before and time.monotonic() < until:
        time.sleep(0.1)
    assert not set(shuffled()) - before and spark.conf.get(FREE_SHUFFLES, None) == ran
    rows = clean.collect()
    assert 0 < sum(n for p, n in shuffled().items() if p not in before) < 1.5 * sum(map(len, made))
    assert {r["row"]["doc_id"]: r["passages_text"] for r in rows} == brute_lines(list(enumerate(made)), True)


def test_line_dedup_takes_texts_apart_once(spark):
    """Once for lines and once for sentences; first places and covers come from the written windows."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    made = ["a\nb\nc. d. e. f", "x\na\nb\nc. d. e. f", "a. b. c. d\n", None, "c. d. e"]
    frame = docs(spark, *made)
    clean = line_dedup.without_repeated_passages(frame.mapInArrow(counted, frame.schema))
    assert read.value == 2 * len(made)
    rows = {r["row"]["doc_id"]: r for r in clean.collect()}
    assert {k: r["text"] for k, r in rows.items()} == brute_lines(list(enumerate(made))) and {k: r["passages_text"] for k, r in rows.items()} == brute_lines(list(enumerate(made)), True)
    assert read.value == 3 * len(made)


def test_line_dedup_of_ids_with_several_texts(spark):
    """Rows with one id and different texts are documents of their own; repeated rows are one."""
    rows = [(1, "a\nb\nc\nx"), (1, "a\nb\nc\ny"), (2, "a\nb\nc"), (3, "u\nv\nw"), (3, "u\nv\nw"), (None, "k\nl\nm"), (None, "k\nl\nm\nn")]
    got = Counter((r["row"]["doc_id"], r["text"]) for r in line_dedup.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    first = [t for i, t in got if i == 1]
    assert sorted(first) in (["a\nb\nc\nx", "y"], ["a\nb\nc\ny", "x"])
    assert sorted(t for i, t in got if i is None) in (["", "k\nl\nm\nn"], ["k\nl\nm", "n"])
    assert got[2, ""] == 1 and got[3, "u\nv\nw"] == 2


def test_line_dedup_on_awkward_rows(spark, awkward):
    got = line_dedup.without_repeats(awkward).collect()
    assert len(got) == len(AWKWARD) and next(r["text"] for r in got if r["row"]["doc_id"] == 7) == "l1 a\nl2 b\nl3 c"
    assert line_dedup.without_repeats(awkward.limit(0)).count() == 0


def test_filters_on_verdicts_stay_above(spark, small):
    """Otherwise a filter pulls the split into words into each word's own evaluation."""
    rows = quality_rules.judged(spark.read.parquet(f"{small}/documents.parquet"))
    text = rows.where("kept")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Filter .*kept#", text) and text.index("Filter") < text.index("Generate")
    assert rows.where("kept").count() == sum(r["kept"] for r in rows.collect())
