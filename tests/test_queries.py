"""Every registered query with SQL equals DuckDB on the smallest data."""

import pytest
from oracle import compare

from casewright import queries as core

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_equals_sql(spark, name):
    compare(spark, SMALL, core.queries()[name], core.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, data, name):
    assert core.queries()[name](spark, data).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 40
    assert set(entry.oracle_sql()) <= set(entry.queries())
