import os

import duckdb
import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(data, columns=None):
    """Rows in an order of their own, floats rounded, for comparison."""
    if hasattr(data, "collect"):
        columns = columns or sorted(data.columns)
        data = data.select(*columns).collect()
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in data)


def same_as_sql(spark, duck, run, sql):
    df = run(spark, SF)
    columns = sorted(df.columns)
    rel = duck.sql(sql)
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    expected = sorted(tuple(f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in at) for r in rel.fetchall())
    assert rows(df, columns) == expected
