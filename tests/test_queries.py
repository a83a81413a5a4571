"""Every query against DuckDB on the smallest tables; those without SQL must give rows."""

import pytest
from compare import connect, differences
from conftest import SMALL

from cooforge import queries as Q


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, con, name):
    df = Q.queries()[name](spark, SMALL)
    if name in Q.oracle_sql():
        assert not differences(df, con, Q.oracle_sql()[name])
    else:
        assert df.count() > 0


def test_entry(spark):
    assert Q.entry(spark, SMALL).count() == 1
