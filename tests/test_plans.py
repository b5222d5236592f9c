"""Physical plans: what is read, what is shuffled, and that nothing leaves the JVM unasked."""

import re

import pytest

from stratalog.plans import registry, views

#: Patterns become regular expressions in Python, rows don't.
LEAVES_JVM = {"content_hash_xxh64", "ignore_scopes_joined"}
#: One row meets many: totals and counts.
ONE_ROW_JOINS = {"archive_stats", "format_share"}
STREAMED = {"stream_counters", "stream_dedup", "worker_states_streamed", "byte_progress_streamed", "observed_stream", "observed_counters"}
#: Bytes of rows whose algorithm has no native form go to Python, null for all others.
PARTLY = {"verify_archive", "verify_counters", "verify_tree"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - STREAMED))
def test_no_python_and_no_products(spark, small, name):
    text = plan(registry.QUERIES[name](spark, small))
    if name not in LEAVES_JVM | PARTLY:
        assert not re.search("Python|Pandas|ArrowEval", text)
    assert "CartesianProduct" not in text
    assert name in ONE_ROW_JOINS or "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned(spark, small):
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz,o_orderstatus:string,o_orderpriority:string>" in re.sub(r"struct<o_orderkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz,o_orderpriority:string>", "struct<o_orderkey:bigint,o_orderdate:timestamp_ntz,o_orderstatus:string,o_orderpriority:string>", plan(registry.QUERIES["list_runs"](spark, small)))
    assert "l_orderkey:bigint>" in plan(registry.QUERIES["list_runs"](spark, small))
    by_run = plan(registry.QUERIES["skipped_by_run"](spark, small))
    assert "EqualTo(source,src3)" in by_run
    assert "n_chars" not in plan(views.files(spark, small).select("id", "checksum"))


def test_files_are_counted_before_the_join(spark, small):
    text = plan(registry.QUERIES["list_runs"](spark, small))
    assert text.index("Join") < text.index("partial_count")


def test_first_writers_have_no_window(spark, small):
    assert "Window" not in plan(registry.QUERIES["first_writer_dedup"](spark, small))


def test_verification_is_one_pass(spark, small):
    text = plan(registry.QUERIES["verify_archive"](spark, small))
    assert text.count("FileScan") == 1 and text.count("ArrowEvalPython") == 1


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - STREAMED))
def test_generated_code_compiles(spark, small, name):
    """With the fallback off, code that can't be compiled is an error."""
    spark.conf.set("spark.sql.codegen.fallback", "false")
    spark.conf.set("spark.sql.codegen.factoryMode", "CODEGEN_ONLY")
    try:
        registry.QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
        spark.conf.unset("spark.sql.codegen.factoryMode")
