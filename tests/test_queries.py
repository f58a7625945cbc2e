import pytest

from foliomill.plans.registry import collect
from tests.oracle import connect, same

QUERIES, SQL = collect()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_like_sql(name, spark, sf_dir, con):
    same(QUERIES[name], SQL[name], spark, sf_dir, con)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() > 0
