import pytest

from conftest import SF01
from oracle_check import compare, duck


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


def _names():
    from __spark_entry__ import oracle_sql
    return sorted(oracle_sql())


@pytest.mark.parametrize("name", _names())
def test_query_matches_oracle(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    problems, _, _ = compare(spark, SF01, name, queries()[name], oracle_sql()[name], con)
    assert not problems, problems


def test_every_query_runs(spark):
    from __spark_entry__ import entry, oracle_sql, queries
    assert set(oracle_sql()) <= set(queries())
    assert entry(spark).count() > 0
