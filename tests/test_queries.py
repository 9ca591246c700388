import os

import pytest

from hushlens.plans import catalogue

from .against_sql import DATA, check

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", catalogue.queries())
def test_query(spark, name):
    check(spark, name, catalogue.queries()[name], SQL.get(name))


def test_every_sql_has_its_query():
    assert set(SQL) <= set(catalogue.queries())
