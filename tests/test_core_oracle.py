"""Every core query with SQL, held against DuckDB on the driver's smallest tables."""

from __future__ import annotations

import pytest
from harness import TABLES, of_duckdb, of_spark

from lodeworks.plans import registry


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, data, name):
    found = of_spark(registry.queries()[name](spark, data))
    wanted = of_duckdb(registry.oracle_sql()[name], {t: f"{data}/{t}.parquet" for t in TABLES})
    assert found == wanted


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
