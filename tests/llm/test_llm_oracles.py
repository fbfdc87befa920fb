"""The registered queries that SQL can express, against their SQL."""

import pytest

from graphloam.llm.queries import ORACLES, QUERIES
from parity import difference


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf, name):
    assert difference(QUERIES[name](spark, sf), ORACLES[name], sf) is None
