import os

import pytest

from hushlens.llm import queries
from tests.against_sql import DATA, check

pytestmark = pytest.mark.skipif(not os.path.exists(DATA), reason="no test tables")
SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", queries.queries())
def test_query(spark, name):
    check(spark, name, queries.queries()[name], SQL.get(name))
