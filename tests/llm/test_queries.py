import pytest

from quillon.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, same_rows, name):
    # a hundred documents can't be mixed to a share within 0.002; mix_target is the same in every size
    df = QUERIES[name](spark, small.replace("sf0.001", "sf0.01") if name == "p9_on_target" else small)
    if name in ORACLES:
        same_rows(df, duck.sql(ORACLES[name]))
    else:
        assert df.count() > 0


def test_registered():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(ORACLES) <= set(e.oracle_sql())
