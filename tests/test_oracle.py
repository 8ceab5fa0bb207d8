"""Every registered query against its SQL, values and types."""

import os

import pytest

import granary.registry.sink_queries  # noqa: F401
import granary.registry.version_queries  # noqa: F401
from granary.registry.compare import connect, differences, run_oracle
from granary.registry.oracles import ORACLES
from granary.registry.queries import QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


def test_every_query_has_sql():
    assert QUERIES.keys() == ORACLES.keys()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF_DIR).toArrow(), run_oracle(con, ORACLES[name])) == []
