"""The pipeline: every stage on its predecessor's rows, held against brute force."""

import zlib
from collections import Counter

import duckdb
from test_operators import WORD, awkward, brute_lines, groups, shingles, water  # noqa: F401

import corpus_pipeline
from stratalog.llm import mixing
from stratalog.llm.scratch import Scratch


def test_stages(spark):
    small = "/root/testdata/sf0.01"
    scratch, seen = Scratch(spark, "stages"), []
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.table(name, stage(spark, docs, small))
        seen.append(docs)
    assert all(d.columns == columns for d in seen[:-1]) and len(seen) == 5
    whole = dict(duckdb.connect().sql(f"SELECT doc_id, text FROM '{small}/documents.parquet'").fetchall())
    toxic = dict(duckdb.connect().sql(f"SELECT doc_id, toxic FROM '{small}/labels.parquet'").fetchall())
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1

    first = {r["doc_id"]: r["text"] for r in seen[0].collect()}
    assert all(first[i] == whole[i] for i in first)
    learnt = [i for i in toxic if not held(i)]
    assert sum((i in first) == (toxic[i] == 0) for i in learnt) / len(learnt) > 0.9
    assert all(i in first for i in toxic if toxic[i] == 0)

    lines = {r["doc_id"]: (r["text"], r["n_chars"]) for r in seen[1].collect()}
    want = brute_lines(list(first.items()), None)
    assert {i: t for i, (t, _) in lines.items()} == want and all(n == len(t) for t, n in lines.values())

    root = groups({i: shingles(t) for i, t in want.items()})
    kept = {r["doc_id"]: (r["source"], r["text"]) for r in seen[2].collect()}
    assert set(kept) == {i for i in want if root[i] == i}

    sizes, taken, largest = Counter(), Counter(), Counter()
    for source, text in kept.values():
        sizes[source] += len(WORD.findall(text))
        largest[source] = max(largest[source], len(WORD.findall(text)))
    mixed = seen[3].orderBy(*corpus_pipeline._stored_order(seen[3])).collect()
    targets = water(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}, 1.5 * sum(sizes.values()))
    for r in mixed:
        assert kept[r["doc_id"]] == (r["source"], r["text"])
        taken[r["source"]] += len(WORD.findall(r["text"]))
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in sizes) and max(Counter(r["doc_id"] for r in mixed).values()) <= 2

    spots = {r["row"]["doc_id"]: list(r["mix"]["positions"]) for r in mixing.mixed(seen[2]).collect()}
    at = [spots[r["doc_id"]].pop(0) for r in mixed]
    assert at == sorted(at) and not any(spots.values())

    pieces = seen[4].collect()
    tokens = {r["doc_id"]: r["doc_tokens"] for r in pieces}
    assert sum(r["length"] for r in pieces) == sum(tokens[r["doc_id"]] for r in mixed)
    order = [r["doc_id"] for r in sorted(pieces, key=lambda r: (r["sequence_id"], r["offset"])) if r["start"] == 0]
    assert order == [r["doc_id"] for r in mixed]


def test_run(spark, small):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run
    rows = corpus_pipeline.run(spark, small)
    assert rows.count() > 0 and rows.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0


def test_stages_on_awkward_rows(spark, small, awkward):
    """Nulls anywhere, empty and long texts, repeated rows, columns that stages use themselves: nothing is lost."""
    docs, scratch = awkward, Scratch(spark, "awkward")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = scratch.table(name, stage(spark, docs, small))
        assert docs.dtypes == awkward.dtypes
    text = "l1 a\nl2 b\nl3 c"  # once, not twice, in document 7
    want = [{**r.asDict(), "text": text, "n_chars": len(text)} if r["doc_id"] == 7 else r.asDict() for r in awkward.collect()]
    assert Counter(str(r.asDict()) for r in docs.collect()) == Counter(map(str, want))
    mixed = scratch.table("mixing", corpus_pipeline.mix_sources(spark, docs, small))
    assert mixed.columns == awkward.columns and {r["doc_id"] for r in mixed.collect()} <= {r["doc_id"] for r in awkward.collect()}
    pieces = corpus_pipeline.pack_sequences(spark, mixed, small)
    assert Counter(r["doc_id"] for r in pieces.where("start = 0").collect()) == Counter(r["doc_id"] for r in mixed.collect())


def test_stages_on_empty_tables(spark, small, awkward):
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, awkward.limit(0), small)
        assert empty.count() == 0 and (name == "packing" or empty.dtypes == awkward.dtypes)


def test_stages_on_ties(spark, small):
    """Equal texts under several ids, equal ids with several texts, and a passage that all share."""
    passage = "\n".join(f"Line {k} of a passage that many texts share." for k in range(4))
    own = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(1, own(1)), (2, own(1)), (2, own(2)), (3, passage + "\n" + own(3)), (4, passage + "\n" + own(4)), (4, passage + "\n" + own(5)), (5, passage)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.reject_toxic(spark, docs, small)
    assert Counter(kept.collect()) == Counter(docs.collect())
    lines = corpus_pipeline.remove_repeated_lines(spark, kept, small).collect()
    assert sum(passage in r["text"] for r in lines) == 1 and all(r["n_chars"] == len(r["text"]) for r in lines)
    assert next(r["text"] for r in lines if r["doc_id"] == 5) == ""
    left = corpus_pipeline.keep_one_of_each_group(spark, kept, small).collect()
    assert sorted(r["doc_id"] for r in left) == [1, 3, 4, 4, 5]
    assert [r["text"] for r in left if r["doc_id"] == 1] == [own(1)]


def test_stored_order_by_task_number(spark, tmp_path):
    for task in (2, 100000, 99999):
        spark.range(task, task + 1).coalesce(1).write.mode("append").parquet(str(tmp_path / "made"))
        found = next(p for p in (tmp_path / "made").glob("part-00000-*.parquet"))
        found.rename(found.with_name(found.name.replace("part-00000", f"part-{task:05d}", 1)))
        crc = found.with_name(f".{found.name}.crc")
        crc.unlink(missing_ok=True)
    docs = spark.read.parquet(str(tmp_path / "made"))
    assert [r["id"] for r in docs.orderBy(*corpus_pipeline._stored_order(docs)).collect()] == [2, 99999, 100000]
