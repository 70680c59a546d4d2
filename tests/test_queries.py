"""Every registered query on the smallest data: equal to its check SQL, or without one, some rows."""

import pytest

from placeledger.plans.registry import all_checks, all_queries
from tests import check

QUERIES, CHECKS = all_queries(), all_checks()
# No store of the smallest data lies in the asked city.
EMPTY_HERE = {"list_stores_by_city"}


@pytest.fixture(scope="module")
def con(data):
    return check.connect(data)


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)
    assert len(QUERIES) >= 180


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EMPTY_HERE))
def test_query(spark, con, data, name):
    assert check.compare(spark, con, data, QUERIES[name], CHECKS.get(name)) is None
