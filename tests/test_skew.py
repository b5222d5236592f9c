"""A checksum that a third of all rows share: no task gets more than a tenth of the rows, and the rows are those of plain loops."""

import pytest
from pyspark.sql import functions as F

from stratalog.operators import catalog
from stratalog.sources import store

ROWS = 6000


@pytest.fixture
def no_broadcast(spark):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "32", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def hot_files(spark):
    k = F.col("id")
    checksum = F.when(k % 3 == 0, F.lit("hot")).when(k % 11 > 0, F.md5((k / 4).cast("bigint").cast("string")))
    return spark.range(ROWS).select("id", checksum.alias("checksum"), F.when(k % 5 == 0, "complete").otherwise("verified").alias("status"), F.concat(F.lit("p/"), k.cast("string")).alias("dest_rel"), F.lit(False).alias("is_duplicate")).repartition(12)


def largest_share(df):
    """Of the rows, the largest task's; all columns are read, so that none is pruned before the shuffle."""
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), *(F.max(F.hash(c)) for c in df.columns)).collect()]
    return max(sizes) / sum(sizes)


def test_first_writers(no_broadcast, hot_files):
    got = catalog.first_writers(hot_files)
    assert largest_share(got) < 0.1
    first = {}
    rows = sorted(got.collect())
    for r in sorted(rows, key=lambda r: r["id"]):
        want = r["id"] if r["checksum"] is None else first.setdefault(r["checksum"], r["id"])
        assert (r["first_id"], r["is_first"]) == (want, want == r["id"])
    assert len(rows) == ROWS


def test_known_copies(no_broadcast, hot_files):
    batch = hot_files.select((F.col("id") + ROWS).alias("id"), F.when(F.col("id") % 7 > 0, F.col("checksum")).otherwise("new").alias("checksum"))
    got = catalog.known_copies(batch, hot_files)
    assert largest_share(got) < 0.1
    known = {}
    for r in sorted(hot_files.where("status = 'complete' and checksum is not null").collect(), key=lambda r: r["id"]):
        known.setdefault(r["checksum"], r["dest_rel"])
    rows = got.collect()
    assert len(rows) == ROWS and all(r["existing"] == known.get(r["checksum"]) for r in rows) and sum(r["existing"] is None for r in rows) > 0


def test_completed(spark, no_broadcast, hot_files):
    finishing = hot_files.where("status = 'verified' and id % 2 = 0").select("id", "checksum")
    old = {r["id"]: r for r in hot_files.collect()}
    known = {r["checksum"] for r in old.values() if r["status"] == "complete"} - {None}
    seen, want = set(known), {}
    for r in sorted(finishing.collect()):
        if r["checksum"] is not None:
            want[r["id"]] = r["checksum"] in seen
            seen.add(r["checksum"])
    got = store.completed(hot_files, finishing)
    assert largest_share(got) < 0.1
    for r in got.collect():
        before = old[r["id"]]
        assert (r["status"], r["is_duplicate"]) == (("complete", want[r["id"]]) if r["id"] in want else (before["status"], False))


def test_completion_deals_the_hot_checksum(no_broadcast, hot_files, monkeypatch):
    """The join inside a completion, before rows meet their ids again."""
    from stratalog import skew

    seen = []
    monkeypatch.setattr(store, "with_known", lambda *a, **b: seen.append(skew.with_known(*a, **b)) or seen[-1])
    store.completed(hot_files, hot_files.where("status = 'verified'").select("id", "checksum"))
    assert largest_share(seen[0]) < 0.1


def test_index_is_not_shuffled(spark, tmp_path, no_broadcast):
    """A catalogue a hundred times the batch: no exchange above the index, and nearly none of its rows pass the filter."""
    from stratalog.sources import index

    files = spark.range(100000).select("id", F.sha1(F.col("id").cast("string")).alias("checksum"), F.lit("complete").alias("status"), F.concat(F.lit("p/"), F.col("id").cast("string")).alias("dest_rel"))
    batch = spark.range(1000).select("id", F.when(F.col("id") % 10 > 0, F.sha1((F.col("id") + 99500).cast("string"))).alias("checksum"))
    index.write(files, "checksum_index_test", str(tmp_path / "index"), 8)
    try:
        got = index.lookup(spark, batch, "checksum_index_test", 8)
        assert sorted(map(str, got.collect())) == sorted(map(str, catalog.known_copies(batch, files).select(*got.columns).collect())) and got.where("existing is not null").count() == 450
        text = got._jdf.queryExecution().executedPlan().toString()
        scan = text.index("checksum_index_test")
        branch = text[text.rindex("Range (", 0, scan) : scan]  # below the join, after the batch's own branch
        assert "Exchange" not in branch and "Bucketed: true" in text[scan:]
        bits = index.bloom_filter(batch, "checksum")
        assert files.where(index.may_hold(bits, F.col("checksum"))).count() < 600
        asked = batch.where("checksum is not null")
        assert asked.where(index.may_hold(bits, F.col("checksum"))).count() == asked.count() == 900
    finally:
        spark.sql("DROP TABLE checksum_index_test")
