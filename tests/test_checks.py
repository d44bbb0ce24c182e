"""Every registered query with a DuckDB twin, on the smallest tables."""

from __future__ import annotations

import pytest

from checks.registry import ORACLES, QUERIES
from tests.compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, connection, name):
    assert differences(QUERIES[name](spark, FOLDER), connection, ORACLES[name])[:2] == []


def test_every_query_has_a_twin():
    assert sorted(QUERIES.keys() - ORACLES.keys()) == [] or all(name.startswith(("op", "pipeline")) for name in QUERIES.keys() - ORACLES.keys())
