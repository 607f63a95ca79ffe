"""Every registered query against its SQL statement on the smallest data set."""

import parity
import pytest
from conftest import SMALL

from chatterlake import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return parity.duck(SMALL)


def test_every_query_has_a_statement():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_same_rows(spark, con, name):
    assert parity.differences(QUERIES[name](spark, SMALL), con, SQL[name]) == []
