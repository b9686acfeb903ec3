import pytest

import __spark_entry__ as contract
from check import compare, duck


@pytest.fixture(scope="module")
def con(small):
    return duck(small)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, small, con, name):
    note = compare(contract.queries()[name](spark, small), con, contract.oracle_sql()[name])
    assert note.startswith("ok"), note
    assert "types" not in note, note
