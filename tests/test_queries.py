"""Every registered query of the engine against its SQL, on the smallest tables."""

import pytest
from helpers import DATA, duck, rows_of

from railspan import registry

FOLDER = f"{DATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_sql(spark, name):
    got = rows_of(registry.QUERIES[name](spark, FOLDER).toPandas())
    assert got == rows_of(duck(registry.SQL[name], FOLDER))


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
