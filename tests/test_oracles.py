"""Every query with SQL against DuckDB on the same tables."""

import pytest

from dwellpath.plans import registry
from tests.conftest import DATA, plain

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})")
    assert sorted(want.columns) == columns
    assert plain(df.select(*columns).collect()) == plain(want.fetchall())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
