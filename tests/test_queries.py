import pytest
from compare import assert_same
from conftest import SF

from quillspark.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", QUERIES)
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert_same(df, duck, ORACLES[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
