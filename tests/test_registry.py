"""Every registered query against its SQL, on the smallest data."""

import compare
import pytest

from veilframe.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, name):
    assert compare.compare(spark, db, QUERIES[name], FOLDER) is None
