"""Byte-level BPE, whitening and source divergence against brute force, and on awkward rows."""

import base64
import hashlib
import random
import re
import struct
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_operators import AWKWARD, DOCS, EXTRA, rows_of

from stratalog import skew
from stratalog.llm import bpe, divergence, entry, near_dedup, packing, textarrays, url_filter, whitening
from stratalog.llm.scratch import Scratch

# 11: byte-level BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(bpe.default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def own_ids(made, most=bpe.CHUNK):
    words = bpe.vocabulary()
    for text in textarrays.texts(pa.array(made, pa.string()), most):
        ids, edges = bpe.ids_of(text, words)
        for k in range(text.rows):
            part = ids[edges[k] : edges[k + 1]]
            assert words.decoded(part) == (made[text.first_row + k] or "").encode()
            yield part.tolist()


def test_pieces_and_merges_equal_the_library(library):
    rng = random.Random(5)
    alphabet = [*"abst'  \n\t.!1９² éß中文'lrevmd", "'s", "'re", "'ll", "'ve", " '", "the", "　", "😀", "\r\n", "x" * 70, "ſ", "\x00", "\x85", "​"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    made += ["a" * n for n in (1, 2, 127, 128, 129, 3000)] + ["ab" * 1500, "=-" * 400, " " * 900, "\n" * 300, "中" * 400, None, "", "<|endoftext|>"]
    made += ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in range(1, 300)]
    assert list(own_ids(made, 5000)) == [library.encode_ordinary(t or "") for t in made]


def test_every_code_point_has_the_library_s_class(library):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    made = ["".join(f"{c}a{c}1{c} {c}!" for c in points[k : k + 4000]) for k in range(0, 0x32000, 4000)] + ["".join(points[0x32000:])]
    assert list(own_ids(made)) == [library.encode_ordinary(t) for t in made]


def test_long_texts_are_cut_between_pieces(library, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice(["hello", " wörld", "中文字 ", "don't", "   ", "\n\n", " a", ". "]) for _ in range(20000))
    monkeypatch.setattr(bpe, "CHUNK", 1000)
    assert len(bpe._cut(np.frombuffer(text.encode(), np.uint8))) > 50
    assert list(own_ids([text])) == [library.encode_ordinary(text)]
    assert len(bpe._cut(np.frombuffer(b"x" * 9000, np.uint8))) == 2


def test_pair_table():
    rng = random.Random(2)
    pairs = {rng.randrange(50) << 32 | rng.randrange(400): k for k in range(3000)}
    table = bpe.PairTable(pairs)
    left, right = np.repeat(np.arange(-1, 55, dtype=np.int32), 420), np.tile(np.arange(-1, 419, dtype=np.int32), 56)
    want = [pairs.get(a << 32 | b, bpe.NONE) if a >= 0 and b >= 0 else bpe.NONE for a, b in zip(left.tolist(), right.tolist(), strict=True)]
    assert table(left, right).tolist() == want


def test_matrix_and_heap_merge_alike():
    rng, words = random.Random(4), bpe.vocabulary()
    for piece in [bytes(rng.choice(b"abcdehtin") for _ in range(rng.randint(2, 120))) for _ in range(300)]:
        row, count = words.merged(words.of_byte[np.frombuffer(piece, np.uint8)][None, :])
        assert row[0, : count[0]].tolist() == words.merged_long(piece)


def test_byte_bpe_query(spark, small, library):
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in entry.op11_byte_bpe(spark, small).collect()}
    rows = rows_of(small, "documents", "doc_id, text")
    assert len(got) == len(rows)
    for doc_id, text in rows:
        ids = library.encode_ordinary(text or "")
        assert got[doc_id] == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


def test_byte_bpe_on_awkward_rows(spark, library):
    docs = spark.createDataFrame(AWKWARD, DOCS).withColumns({c: F.lit(1) for c in (*EXTRA, "ids", "n_tokens", "decoded")})
    got = sorted(((r["doc_id"], r["n_tokens"], bytes(r["decoded"])) for r in bpe.decode(bpe.encode(docs)).collect()), key=str)
    assert got == sorted(((r[0], len(library.encode_ordinary(r[1] or "")), (r[1] or "").encode()) for r in AWKWARD), key=str)
    assert bpe.decode(bpe.encode(docs.limit(0))).count() == 0
    broken = spark.createDataFrame([(None,), (b"",), (struct.pack("<I", 1 << 20),)], "ids binary")
    assert [r["decoded"] for r in bpe.decode(broken).collect()] == [None, b"", None]


# 12: whitening


def exact_model(rows):
    """n, sums and n * X'X - S S' of distinct rows as Python integers."""
    fit = [list(x) for x in set(map(tuple, rows))]
    n, d = len(fit), len(fit[0])
    total = [sum(x[i] for x in fit) for i in range(d)]
    return n, total, [[n * sum(x[i] * x[j] for x in fit) - total[i] * total[j] for j in range(d)] for i in range(d)]


@pytest.mark.parametrize("size", [50, 1 << 21, 1 << 40, 1 << 61])
def test_scatter_is_exact(size):
    rng = random.Random(size)
    x = np.array([[rng.randint(-size, size) for _ in range(3)] for _ in range(300)] + [[size] * 3, [-size] * 3])
    total, product = whitening.scatter(x)
    plain = x.astype(object)
    assert total == plain.sum(0).tolist() and product == plain.T.dot(plain).tolist()
    for v in (0, 1, -1, size**2 * 7, -(size**2) * 9):
        assert sum(c << (32 * k) for k, c in enumerate(whitening._digits(v))) == v


@pytest.mark.parametrize("spread", [1, 10**7, 10**15])
def test_model_against_fractions(spark, spread):
    rng = random.Random(spread)
    rows = [[1000000 + round(rng.gauss(0, 30) * spread * (k + 1)) for k in range(4)] for _ in range(200)]
    frame = spark.createDataFrame([(x,) for x in rows + rows[:50]], "x array<bigint>").distinct().repartition(5)
    model = whitening.fit(frame)
    n, total, scatter = exact_model(rows)
    assert model.n == n and [t + n * model.offset for t in model.total] == total
    covariance = np.array([[float(Fraction(v, n * n)) for v in row] for row in scatter])
    assert np.allclose(model.vectors @ np.diag(model.values) @ model.vectors.T, covariance, rtol=1e-12, atol=1e-12 * np.abs(covariance).max())
    assert np.isclose(model.trace, np.trace(covariance), rtol=1e-14) and (np.diff(model.values) <= 0).all()
    deviations = [sum((n * v - s) ** 2 for v, s in zip(x, total, strict=True)) for x in rows]
    assert model.deviations(np.array(rows) - model.offset) == [v if v < 1 << 63 else None for v in deviations]
    assert whitening.identity_error(frame, model, 4) < 1e-9


def test_whitening_query(spark, small):
    got = entry.op12_embedding_whitening(spark, small).toPandas()
    rows = dict(rows_of(small, "embeddings", "vec_id, embedding"))
    x = {k: np.floor(np.array(v, np.float64) * 64).astype(np.int64) + 1000000 for k, v in rows.items()}
    n, total, scatter = exact_model([v.tolist() for v in x.values()])
    values, vectors = np.linalg.eigh(np.array([[float(Fraction(v, n * n)) for v in row] for row in scatter]))
    values, vectors = values[::-1], vectors[:, ::-1]
    assert len(got) == 16 * len(rows) and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-9
    mean = np.array([float(Fraction(s, n) - 1000000) for s in total])
    for vec_id, part in got.groupby("vec_id"):
        part = part.sort_values("component")
        assert part.component.tolist() == list(range(1, 17))
        assert set(part.deviation) == {sum((n * int(v) - s) ** 2 for v, s in zip(x[vec_id], total, strict=True))}
        want = (x[vec_id] - 1000000 - mean) @ vectors[:, :16] / np.sqrt(values[:16])
        assert np.allclose(np.abs(part.whitened), np.abs(want), atol=1e-8) and np.allclose(part.explained, values[:16] / values.sum(), rtol=1e-9)


def test_whitening_on_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    made = [(1, [0.5, 1.0]), (2, [0.5, 1.0]), (3, [-0.25, 2.0]), (4, [1.5, -1.0]), (4, [1.5, -1.0]), (None, [0.0, 0.25]), (5, None), (6, []), (7, [1.0, None]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(made, "vec_id bigint, embedding array<float>").withColumns({c: F.lit(1) for c in (*EXTRA, "x", "n", "whitened")})
    got = whitening.whitened(frame).collect()
    assert sorted(str(r["row"]["vec_id"]) for r in got) == ["1", "2", "3", "4", "4", "None"] and {r["n"] for r in got} == {4}
    assert {len(r["whitened"]) for r in got} == {2} and len({str(r["whitened"]) for r in got if r["row"]["vec_id"] in (1, 2)}) == 1
    assert whitening.whitened(frame.limit(0)).count() == 0 and whitening.whitened(frame.where("vec_id = 6")).count() == 0
    same = whitening.whitened(frame.where("vec_id = 4")).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in same] == [(1, 0, [None, None], 0.0)] * 2
    line = whitening.whitened(spark.createDataFrame([(k, [float(k), 2.0 * k, 1.0]) for k in range(9)], "vec_id bigint, embedding array<double>"), keep=["vec_id"]).collect()
    assert all(r["whitened"][0] is not None and r["whitened"][1:] == [None, None] and r["identity_error"] < 1e-9 for r in line)
    huge = whitening.whitened(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 3.0])], "vec_id bigint, embedding array<double>")).collect()
    assert [r["deviation"] for r in huge] == [None, None] and {abs(round(r["whitened"][0], 9)) for r in huge} == {1.0}


# 13: source divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_divergence(rows, top=200):
    held, found, groups = defaultdict(set), defaultdict(Counter), defaultdict(set)
    for k, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        for term in TERM.findall((text or "").translate(LOWER)):
            held[lang, term].add(k)
            found[lang, source][term] += 1
    out, f = [], lambda p, q: (p - q) ** 2 // q
    for lang, sources in groups.items():
        kept = sorted(t for (g, t), d in held.items() if g == lang and len(d) >= 3)
        share = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept))  # noqa: E731, B023
        whole = Counter()
        for s in sources:
            whole.update(found[lang, s])
        p = {s: {t: share(found[lang, s], t) for t in kept} for s in sources}
        q = {t: share(whole, t) for t in kept}
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            words = [(t, f(p[s][t], q[t])) for t in kept if found[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, 1 << 60), ("term", words, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items[:most], 1)]
    return sorted(out)


def made_texts(seed, n=120):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "éclair", "中文字", "X", "don't", "a1b", "ZZ", " ", "İ", "q" * 700] + [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200)]
    texts = [" ".join(rng.choice(words[: rng.choice((5, 40, 211))]) for _ in range(rng.randint(0, 30))) for _ in range(n)]
    rows = [(rng.choice(("en", "en", "de", None)), "hot" if rng.random() < 0.4 else rng.choice(("a", "b", "é", None, "")), t) for t in texts]
    return rows + [("fr", "only", None), ("fr", "other", "two words"), ("it", "x", "once"), (None, None, None), ("en", "empty", ""), ("en", "hot", "hot " * 5000)] + rows[:10]


@pytest.mark.parametrize("seed", range(2))
def test_divergence_against_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(divergence, "SALTS", 3)
    rows = made_texts(seed)
    frame = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5).withColumns({c: F.lit(1) for c in EXTRA if c not in ("lang", "source", "text")})
    got = divergence.divergence(frame, top=7, width=1 << 6 if seed else 1 << 12)
    assert sorted(map(tuple, got.collect())) == brute_divergence(rows, 7)


def test_divergence_shuffles_terms_once(spark, monkeypatch):
    """Exact counts, documents of the language and its counts come from one shuffle by term, and each task adds its chunks up."""
    plans, write = {}, Scratch.table

    def table(self, name, df, **more):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return write(self, name, df, **more)

    monkeypatch.setattr(Scratch, "table", table)
    rows = made_texts(3)
    frame = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    assert sorted(map(tuple, divergence.divergence(frame).collect())) == brute_divergence(rows)
    assert plans["kept"].count("Exchange hashpartitioning") == 1 and "Join" not in plans["kept"]


def test_divergence_adds_chunks_up(spark):
    """Texts of several chunks, and more counts than are held at once, of terms that all chunks share."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(40000)]
    rows = [("en", f"s{k % 3}", " ".join(rng.sample(words, 36000))) for k in range(36)]
    frame = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    kept = {(r["source"], r["term"]): (r["count"], r["in_lang"], r["first"]) for r in divergence.counts(Scratch(spark, "counts"), frame).collect()}
    found, held = Counter(), Counter()
    for _, source, text in rows:
        found.update((source, t) for t in text.split())
        held.update(set(text.split()))
    in_lang = Counter()
    for (_, t), n in found.items():
        in_lang[t] += n
    assert kept == {(s, t): (n, in_lang[t], s == min(x for x in ("s0", "s1", "s2") if found[x, t])) for (s, t), n in found.items() if held[t] >= 3}


def test_shares_beyond_64_bits(spark):
    """Counts whose product with the unit needs more than 64 bits are exact too."""
    made = [(c, c + d, v) for c in (0, 1, 9223372034, 9223372035, 9223372036, 9223372037, 1 << 40, 1 << 61) for d in (0, 12345, 1 << 33) for v in (1, 999)]
    got = spark.createDataFrame(made, "c bigint, n bigint, v bigint").select("c", "n", "v", divergence._p("c", "n", "v").alias("p")).collect()
    assert len(got) == len(made) and all(r["p"] == 1 + 10**9 * (r["c"] + 1) // (r["n"] + r["v"]) for r in got)


def test_sketch_never_underestimates(spark):
    rows = made_texts(9)
    frame = spark.createDataFrame(rows, "lang string, source string, text string").repartition(6)
    width = 256
    table = np.zeros(divergence.DEPTH * width, np.uint8)
    for r in divergence.sketch(Scratch(spark, "sketch"), frame, 3, width).collect():
        block = np.frombuffer(r["cells"], np.uint8)
        table[r["block"] * len(block) : (r["block"] + 1) * len(block)] = block
    held = defaultdict(set)
    for k, (lang, _, text) in enumerate(rows):
        for term in TERM.findall((text or "").translate(LOWER)):
            held[lang or "", term].add(k)
    dropped = 0
    for (lang, term), docs in held.items():
        text = next(textarrays.texts(pa.array([term])))
        *_, keys = divergence._keys(text, divergence._hashed(pa.array([lang])))
        least = min(int(table[k * width + c]) for k, c in enumerate(divergence.cells(keys[:1], width)[:, 0]))
        assert least >= min(3, len(docs))
        dropped += least < 3
    assert dropped > 0


def test_divergence_on_awkward_rows(spark):
    frame = spark.createDataFrame(AWKWARD, DOCS)
    assert sorted(map(tuple, divergence.divergence(frame).collect())) == brute_divergence([(r[2], r[3], r[1]) for r in AWKWARD])
    assert divergence.divergence(frame.limit(0)).count() == 0


# Hot keys: a third of all rows on one id, url or centre


def largest_share(df):
    """Of the rows, the largest task's; all columns are read, so that none is pruned before the shuffle."""
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), *(F.max(F.hash(c)) for c in df.columns)).collect()]
    return max(sizes) / sum(sizes)


@pytest.fixture
def finely_split(spark):
    settings = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_packing_spreads_null_ids(spark, finely_split):
    rows = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.md5(F.col("id").cast("string")).alias("text")).repartition(8)
    assert largest_share(packing.pack(rows, [rows["doc_id"]])) < 0.1


@pytest.mark.parametrize("hot", [None, "no address", "http://a.example.net/en/x"])
def test_url_filters_spread_one_url(spark, finely_split, hot):
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, F.lit(hot)).otherwise(F.concat(F.lit("http://h.example.org/"), F.col("id"), F.lit("/" + "y" * 40))).alias("url"), *(F.sha2(F.concat(F.lit(k), "id"), 512).alias(f"html{k}") for k in "abc")).repartition(24)
    rules = spark.createDataFrame([("net", "/", "block"), ("org", "/", "allow")], "host string, path string, verdict string")
    assert largest_share(url_filter.judge(pages, rules)) < 0.1


def test_links_spread_one_centre(spark, finely_split, monkeypatch):
    """All candidates of one centre, a third of all pairs; its groups of candidates meet the texts in more than one task."""
    seen = []
    monkeypatch.setattr(near_dedup, "GROUP", 16)
    monkeypatch.setattr(near_dedup, "salted", lambda *a, **b: seen.append(skew.salted(*a, **b)) or seen[-1])
    pairs = spark.range(6000).select(F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.floor(F.col("id") / 7)).cast("bigint").alias("c"), (F.col("id") + 10000).alias("x"))
    bodies = spark.range(17000).select("id", F.lit("one two three four five six").alias("text"))
    links = near_dedup._links(Scratch(spark, "hot"), pairs, bodies, "links")
    assert links.count() == 6000 and largest_share(seen[0]) < 0.1
