"""Every query of the registry against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest
from quillgraph.plans.queries import ORACLES, QUERIES

from tests import oracle

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    if name in ORACLES:
        assert oracle.differences(spark, QUERIES[name], ORACLES[name], DATA, duck) == ""
    else:
        assert QUERIES[name](spark, DATA).count() >= 0
