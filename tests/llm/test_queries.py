"""Queries with an SQL twin give the same rows as DuckDB; those without are held against brute force in test_operators."""

import pytest

from chunklake.llm import registry
from tests.conftest import same_as_sql

ORACLE = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    same_as_sql(spark, duck, registry.queries()[name], ORACLE[name])


def test_all_ten_are_there():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}
    assert "pipeline" in names
