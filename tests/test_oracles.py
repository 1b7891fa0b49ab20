"""Every registered core query against its SQL twin on the smallest tables."""

import pytest

from quillon.queries import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, same_rows, name):
    df = QUERIES[name](spark, small)
    if name in ORACLES:
        same_rows(df, duck.sql(ORACLES[name]))
    else:
        assert df.count() >= 0


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
