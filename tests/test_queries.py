import pytest

from tests.oracle import both, connection
from weftline.plans import QUERIES, SQL

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(spark, con, name):
    got, want = both(spark, con, QUERIES[name], SQL[name], SF)
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert got[1]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
