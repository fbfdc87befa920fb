"""Every registered query of the code-graph operators against its SQL, on the smallest tables."""

import pytest

from graphloam.queries import ORACLES, QUERIES
from parity import difference


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    assert difference(QUERIES[name](spark, sf), ORACLES[name], sf) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
