"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import os

import pytest
from harness import compare, duck

from gitstrata.plans import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        problem = compare(df, con, ORACLES[name])
        assert problem is None, problem
    else:
        assert df.count() > 0
