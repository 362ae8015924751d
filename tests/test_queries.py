"""Every query against its SQL at the smallest size."""

import oracle
import pytest

from glyphmill.plans import queries

MADE, SQL = queries.queries(), queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(MADE))
def test_query(spark, name):
    n = oracle.compare(MADE[name](spark, oracle.SMALL), SQL[name])
    assert n > 0
