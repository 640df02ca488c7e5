"""Every query with an SQL twin gives the same rows as DuckDB."""

import pytest

from chunklake.plans import registry
from tests.conftest import SF, same_as_sql

ORACLE = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    same_as_sql(spark, duck, registry.queries()[name], ORACLE[name])


def test_content_defined_chunks_tile_their_object(spark):
    from pyspark.sql import functions as F

    df = registry.queries()["cdc_chunks"](spark, SF)
    sizes = {r["doc_id"]: r["n"] for r in df.groupBy("doc_id").agg(F.sum("size").alias("n")).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        assert sizes.get(r["doc_id"], 0) == len((r["text"] or "").encode())


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0
    assert set(registry.queries()) <= set(__spark_entry__.queries())
