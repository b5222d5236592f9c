"""Every registered catalogue query against its SQL."""

import pytest
from conftest import compare

from stratalog.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, name):
    rows = registry.QUERIES[name](spark, small)
    if name not in registry.ORACLE_SQL:
        assert rows.count() > 0
        return
    got, want = compare(rows, registry.ORACLE_SQL[name], small)
    assert got == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
