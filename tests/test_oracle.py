"""Every registered query against its SQL, on the smallest test tables."""

import pytest

from tests.compare import connect, differences
from workloads import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_same_rows(spark, duck, name):
    message, _, _ = differences(spark, duck, SF, catalog.QUERIES[name], catalog.ORACLE[name])
    assert message is None, message
