import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


def compare(spark_frame, sql, sf_dir):
    """Rows of a Spark query and of its SQL as sorted text."""
    import duckdb

    db = duckdb.connect()
    db.sql("SET timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    got, want = spark_frame.toPandas(), db.sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    text = lambda df: sorted(tuple("null" if v is None or v != v else str(v) for v in row) for row in df[columns].itertuples(index=False))
    return text(got), text(want)
