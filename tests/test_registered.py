"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import __spark_entry__ as entry
import pytest
from compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, SF, QUERIES, ORACLES) is None


def test_entry(spark):
    assert entry.entry(spark).count() == 4
