"""Every registered query against its SQL oracle, over whole tables."""

import pytest

from logweave import plans
from tests.check import compare, connect

SF = "/root/testdata/sf0.001"
JOBS, ORACLES = plans.load()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(JOBS)


@pytest.mark.parametrize("name", sorted(JOBS))
def test_query(spark, con, name):
    if name in ORACLES:
        assert compare(spark, con, JOBS[name], ORACLES[name], SF) == ""
    else:
        assert JOBS[name](spark, SF).count() >= 0
