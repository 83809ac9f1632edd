"""Every query of the registry against its SQL on the smallest tables, by value."""

import pytest

from __spark_entry__ import entry
from registry.oracles import ORACLES
from registry.queries import QUERIES
from tests.compare import differences, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF).toPandas(), con.execute(ORACLES[name]).df()) is None


def test_entry(spark):
    assert entry(spark).count() > 0
